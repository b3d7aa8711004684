"""Pre-hashes of a DataFrame of events.

Events made of plain standard fields are written by Column expressions, generated from the template. All others (extensions, ilmd,
sensor data, unexpected shapes at any level) go through the tree, in an Arrow UDF, to which plain events are nulls. The routing looks
at every key at every level, as a typed struct would silently drop what it doesn't know.

Each event is read once and parsed twice: as a map of raw fields, and as a struct of the fields that hold lists and objects. What many
expressions use is a column of a projection of its own, which the optimizer does not merge into those that mention it more than once, or
is bound by let in a lambda, so that it is not computed anew for each mention. (Generators are not compiled if a lambda is in them.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identifiers import digital_link_column, let, vocabulary_column
from plumbline.functions.values import instant_column, number_column, timestamp_column
from plumbline.operators import canonical_tree
from plumbline.schema import BARE, CBV, EPC_LISTS, EVENT_TYPES, QUANTITY_LISTS, TEMPLATE, TOP, Options

_SCALARS = ["type", "eventTime", "eventTimeZoneOffset", "parentID", "action", "transformationID", "bizStep", "disposition"]
_LINES = _SCALARS[2:]  # those that known writes
_PLACES = ["readPoint", "bizLocation"]
_PAIRS = ["bizTransactionList", "sourceList", "destinationList"]


def _leaf(holder: str, name: str) -> Column:
    """What known has to know of a standard leaf, as a literal. All are of one type, so that an array of them is no cast a row."""
    bare = BARE.get((holder, name))
    return F.struct(F.lit(name).alias("name"), F.lit(f"{name}=").alias("lead"), F.lit(name in ("epc", "epcClass", "id")).alias("identifier"), F.lit(f"{name}={CBV}{bare}" if bare else "").alias("bare"))


def linked(value: Column) -> Column:
    """A URN as its link, any other value as it is."""
    return F.when(value.startswith("urn:epc:"), digital_link_column(value)).otherwise(value)


def known(leaf: Column, value: Column) -> Column:
    """name=value of a standard leaf (_leaf) but for the event's type and time, as Canonical._known has it for the fields of plain events.
    The value is linked; other links never get here."""
    eq = lambda x: F.concat(leaf["lead"], x)
    return (
        F.when(value.isNull(), None)
        .when(leaf["identifier"] | value.startswith("http") | value.startswith("urn:epc:"), eq(value))
        .when(value.startswith("urn:epcglobal:cbv:"), eq(vocabulary_column(value)))
        .when((leaf["bare"] != "") & (value != "") & ~value.contains(":"), F.concat(leaf["bare"], value))
        .when(value.startswith("gs1:"), eq(F.substr(value, F.lit(5))))
        .when(value.isin(EVENT_TYPES), F.concat(F.lit("eventType="), value))
        .when(value == "", leaf["name"])
        .otherwise(eq(number_column(value)))
    )


def _raw(name: str) -> Column:
    return F.element_at(F.col("__m"), F.lit(name))


def _held(name: str) -> Column:
    """The parsed value of a list or place; null if it has another shape."""
    return F.col(f"__p.{name}")


#: Shapes of the fields that hold others.
_SHAPES = {**{x: "array<string>" for x in EPC_LISTS}, **{x: "array<map<string,string>>" for x in [*QUANTITY_LISTS, *_PAIRS]}, **{x: "map<string,string>" for x in _PLACES}}


def parsed(events: DataFrame) -> DataFrame:
    """events with __m, the fields as raw JSON, and __p, those of _SHAPES."""
    shapes = ", ".join(f"{name}: {shape}" for name, shape in _SHAPES.items())
    return events.select("*", F.from_json("event_json", "map<string,string>").alias("__m"), F.from_json("event_json", f"struct<{shapes}>").alias("__p"))


def is_plain(options: Options) -> Column:
    """Whether the expressions below write this event as the tree would. It is parsed.

    The text of a value is read from the map, so a nested one begins with a bracket; nulls and links take the tree.
    """
    handled, excluded = [*_SCALARS, *EPC_LISTS, *QUANTITY_LISTS, *_PLACES, *_PAIRS], options.excluded()
    allowed = [x for x in dict.fromkeys([*handled, *excluded]) if x not in ("@context", "ilmd")]
    flat = lambda v: ~v.startswith("[") & ~v.startswith("{") & ~v.contains("://")
    absent_or = lambda name, x: _raw(name).isNull() | F.coalesce(x, F.lit(False))
    ok = F.col("__m").isNotNull() & F.forall(F.map_entries("__m"), lambda e: e["key"].isin(allowed) & (e["value"].isNotNull() | e["key"].isin(excluded)))
    ok &= _raw("type").isin(EVENT_TYPES) & _raw("eventTime").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)\z") & timestamp_column(_raw("eventTime")).isNotNull()
    for name in _SCALARS:
        ok &= absent_or(name, flat(_raw(name)))
    # Of what is no string, none begins as these do.
    schemes = [f"urn:epc:id:{x}" for x in ("sgtin", "sscc", "sgln", "grai", "giai", "gdti", "gsrn", "cpi", "pgln")]
    for name in EPC_LISTS:
        ok &= absent_or(name, _raw(name).startswith("[") & F.forall(_held(name), lambda x: F.coalesce(F.substring_index(x, ":", 4).isin(schemes) & ~x.contains("://"), F.lit(False))))
    for name in [*QUANTITY_LISTS, *_PAIRS]:
        entry = lambda e: e["key"].isin(TEMPLATE[name]) & F.coalesce(flat(e["value"]), F.lit(False)) & (~e["key"].isin("source", "destination", "bizTransaction", "uom") | e["value"].rlike(r"\S"))  # noqa: B023, E731
        ok &= absent_or(name, _raw(name).startswith("[") & F.forall(_held(name), lambda x: F.coalesce(F.forall(F.map_entries(x), entry), F.lit(False))))  # noqa: B023
    for name in _PLACES:
        ok &= absent_or(name, _raw(name).startswith("{") & F.forall(F.map_entries(_held(name)), lambda e: (e["key"] == "id") & F.coalesce(flat(e["value"]), F.lit(False))))
    return F.coalesce(ok, F.lit(False))


def _parts(options: Options) -> Column:
    """What the lines of a parsed event are made of: scalars, linked; lines of the lists of EPCs and of those of objects.

    Each is one array that one lambda goes over, so that the plan stays small; an event without lists has none of them.
    """
    excluded = options.excluded()
    leaves = [*[(_leaf("", x), _raw(x)) for x in _LINES], *[(_leaf(x, "id"), F.element_at(_held(x), F.lit("id"))) for x in _PLACES]]
    leaf = F.array(*[F.struct(f.alias("f"), v.alias("v")) for f, v in leaves])
    epcs = F.array(*[F.struct(F.lit(x).alias("n"), F.sort_array(_held(x)).alias("o")) for x in EPC_LISTS])

    def fields(name: str) -> Column:
        kept = [_leaf(name, f) for f in TEMPLATE[name] if f not in excluded]
        return F.array(*kept) if kept else F.slice(F.array(_leaf(name, "")), 1, 0)

    lists = [*QUANTITY_LISTS, *_PAIRS]
    objects = F.array(*[F.struct(fields(x).alias("f"), F.lit(x).alias("n"), F.lit(x in QUANTITY_LISTS).alias("q"), _held(x).alias("o")) for x in lists])
    any_of = lambda names: F.coalesce(*map(_raw, names)).isNotNull()

    def element(x: Column, m: Column) -> Column:
        own = F.filter(F.transform(x["f"], lambda f: let(linked(F.element_at(m, f["name"])), lambda v: known(f, v))), lambda line: line.isNotNull())
        return let(own, lambda o: F.struct(F.array_join(o, "").alias("k"), F.when(x["q"] & (F.size(o) > 0), F.concat(F.array(F.lit("quantityElement")), o)).otherwise(o).alias("v")))

    body = lambda x: F.flatten(F.transform(F.sort_array(F.transform(x["o"], lambda m: element(x, m))), lambda y: y["v"]))
    of_objects = F.transform(objects, lambda x: F.when(F.size(x["o"]) > 0, F.concat(F.array(x["n"]), body(x))))
    return F.struct(
        _raw("type").alias("type"),
        instant_column(_raw("eventTime")).alias("eventTime"),
        F.transform(leaf, lambda x: F.when(x["v"].isNotNull(), let(linked(x["v"]), lambda v: known(x["f"], v)))).alias("leaf"),
        F.when(any_of(EPC_LISTS), F.transform(epcs, lambda x: F.when(F.size(x["o"]) > 0, F.concat(F.array(x["n"]), F.transform(x["o"], lambda e: F.concat(F.lit("epc="), digital_link_column(e))))))).alias("epcs"),
        F.when(any_of(lists), of_objects).alias("objects"),
    )


def lines(options: Options, parts: Column) -> Column:
    """All lines of a plain event in the template's order, from its _parts, as one text."""
    excluded, out = options.excluded(), []
    for name in TOP:
        if name in excluded or name not in [*_SCALARS, *_SHAPES]:
            continue
        if name in ("type", "eventTime"):
            out.append(F.concat(F.lit("eventType=" if name == "type" else "eventTime="), parts[name]))
        elif name in [*_LINES, *_PLACES]:
            line = F.get(parts["leaf"], F.lit([*_LINES, *_PLACES].index(name)))
            out.append(F.concat(F.lit(f"{name}\n"), line) if name in _PLACES else line)
        else:
            out.append(F.get(parts["epcs"], F.lit(EPC_LISTS.index(name))) if name in EPC_LISTS else F.get(parts["objects"], F.lit([*QUANTITY_LISTS, *_PAIRS].index(name))))
    return F.concat_ws("\n", *out)


def prehash(events: DataFrame, options: Options | None = None, *, drop_empty: bool = False) -> DataFrame:
    """events with prehash (lines; "" for document headers) and error (null if there is none). Needs event_json and namespaces.

    drop_empty leaves out events with an empty pre-hash. Columns of the events named prehash or error are replaced.
    """
    options = options or Options()
    events = events.drop("prehash", "error")
    df = parsed(events).select(*events.columns, F.when(is_plain(options), _parts(options)).alias("__parts"))
    # What was parsed is dropped before the UDF, past which each row is copied whole.
    df = df.select(*events.columns, F.when(F.col("__parts").isNotNull(), lines(options, F.col("__parts"))).alias("__text"))
    rest = lambda name: F.when(F.col("__text").isNull(), F.col(name))
    df = df.withColumn("__tree", tree_udf(options)(rest("event_json"), rest("namespaces"), F.col("__text").isNull()))
    found = F.array(F.struct(F.coalesce("__text", "__tree.prehash").alias("prehash"), F.col("__tree.error").alias("error")))
    kept = F.filter(found, lambda x: x["prehash"].isNull() | (x["prehash"] != "")) if drop_empty else found
    df = df.select(*events.columns, F.explode(kept).alias("__out"))
    return df.select(*events.columns, "__out.prehash", "__out.error")


def tree_udf(options: Options):
    """(event_json, namespaces, whether to do it) to prehash and error, by the tree."""
    excluded, version, failfast = frozenset(options.excluded()), options.version, options.failfast

    def run(events: pa.Array, namespaces: pa.Array, wanted: pa.Array) -> pa.Array:
        texts: list[str | None] = [None] * len(events)
        errors: list[str | None] = [None] * len(events)
        at = np.flatnonzero(wanted.to_numpy(zero_copy_only=False))
        spaces: list | pa.Array = namespaces.take(pa.array(at)) if len(at) < len(events) else namespaces
        for i, text, ns in zip(at.tolist(), (events.take(pa.array(at)) if len(at) < len(events) else events).to_pylist(), spaces.to_pylist(), strict=True):
            try:
                texts[i] = canonical_tree.prehash(text or "", dict(ns or []), excluded, version)
            except (ValueError, TypeError, RecursionError) as e:
                if failfast:
                    raise RuntimeError(f"Exception occurred during event hash generation : {e}") from e
                errors[i] = str(e)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["prehash", "error"])

    return F.arrow_udf(run, "prehash string, error string")


def by_tree(events: DataFrame, options: Options | None = None) -> DataFrame:
    """prehash for any events, by the tree."""
    events = events.drop("prehash", "error")
    df = events.withColumn("__tree", tree_udf(options or Options())("event_json", "namespaces", F.lit(True)))
    return df.select(*events.columns, "__tree.prehash", "__tree.error")
