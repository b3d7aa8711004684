"""What content hashes are for: duplicates, new events, integrity, equivalence of corpora, digests of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, hash_id: str, id_: str) -> DataFrame:
    """Hashes found more than once: n and the least id. Sums are made before the shuffle, so a hot hash is a row a task."""
    return df.groupBy(hash_id).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).filter("n > 1")


def keep_first(df: DataFrame, hash_id: str, *order: str) -> DataFrame:
    """The first row of each hash, by an aggregate that combines before its one shuffle, so a hot hash is a row a task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.groupBy(F.col(f"`{hash_id}`").alias("__h")).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def new_events(df: DataFrame, store: DataFrame, hash_id: str) -> DataFrame:
    return df.join(store.select(hash_id).distinct(), hash_id, "left_anti")


def integrity(df: DataFrame, stored: DataFrame, id_: str, hash_id: str) -> DataFrame:
    """Ids whose stored hash is not the recomputed one, or is missing."""
    s = stored.select(F.col(id_).alias("__i"), F.col(hash_id).alias("stored_hash"))
    return df.join(s, df[id_] == s["__i"], "left").filter(~F.col(hash_id).eqNullSafe(F.col("stored_hash"))).drop("__i")


def equivalent(left: DataFrame, right: DataFrame, hash_id: str) -> DataFrame:
    """Hashes of one corpus only, repeats counted: side and hash; empty for equivalent corpora."""
    a, b = left.select(hash_id), right.select(hash_id)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


#: Limbs of 32 bits of a digest that are summed.
_LIMBS = 8


def set_digest(hashes: Column) -> Column:
    """An aggregate: the digest of a group's hashes in any order, repeats counted.

    The hashes' own SHA-256 digests are summed, limb by limb, modulo 2**32, and the sums and their number hashed again. Sums combine
    before the shuffle, so a group of any size is a row a task. Null hashes don't count.
    """
    d = F.sha2(hashes, 256)
    limb = lambda k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
    sums = [F.lpad(F.lower(F.hex(F.coalesce(F.sum(limb(k)), F.lit(0)) % (1 << 32))), 8, "0") for k in range(_LIMBS)]
    return F.sha2(F.concat(*sums, F.lit(":"), F.count(hashes).cast("string")), 256)
