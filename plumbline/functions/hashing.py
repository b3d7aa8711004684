"""Digests of pre-hash strings as ``ni:///<algorithm>;<hex>?ver=CBV<version>``, with functions of the JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schema import ALGORITHMS

_SHA2 = {"sha-224": 224, "sha-256": 256, "sha-384": 384, "sha-512": 512}
_CODEC = {"sha3-224": "sha3_224Hex", "sha3-256": "sha3_256Hex", "sha3-384": "sha3_384Hex", "sha3-512": "sha3_512Hex", "md2": "md2Hex"}


def hash_input(prehash: Column) -> Column:
    return F.regexp_replace(prehash, r"[\n\r]", "")


def shown(prehash: Column, join: str = "") -> Column:
    """Line breaks become the join string, taken literally."""
    return F.regexp_replace(prehash, r"[\n\r]+", join.replace("\\", "\\\\").replace("$", "\\$"))


def algorithm(name: str, strict: bool = False) -> str:
    known = name.strip().lower()
    if known in ALGORITHMS:
        return known
    if strict:
        raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(ALGORITHMS)}")
    return "sha-256"


def digest(text: Column, name: str) -> Column:
    if name in _SHA2:
        return F.sha2(text, _SHA2[name])
    if name in _CODEC:  # commons-codec is on Spark's class path; a null argument would raise
        return F.when(text.isNotNull(), F.call_function("reflect", F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit(_CODEC[name]), F.coalesce(text, F.lit(""))))
    return F.sha1(text) if name == "sha-1" else F.md5(text)


def digest_sql(text: str, name: str) -> str:
    """digest as SQL; text: a name that is not null."""
    if name in _SHA2:
        return f"sha2({text}, {_SHA2[name]})"
    if name in _CODEC:
        return f"reflect('org.apache.commons.codec.digest.DigestUtils', '{_CODEC[name]}', coalesce({text}, ''))"
    return f"{name.replace('-', '')}({text})"


def hash_id(prehash: Column, name: str = "sha-256", version: str = "2.0", strict: bool = False) -> Column:
    known = algorithm(name, strict)
    return F.concat(F.lit(f"ni:///{known};"), digest(hash_input(prehash), known), F.lit(f"?ver=CBV{version}"))


def outputs(prehash: Column, algorithms: tuple[str, ...], *, join: str = "", version: str = "2.0", strict: bool = False) -> dict[str, Column]:
    """A column for each output, by the caller's spelling; "prehash" is the shown pre-hash."""
    return {x: shown(prehash, join) if x.lower() == "prehash" else hash_id(prehash, x, version, strict) for x in algorithms}
