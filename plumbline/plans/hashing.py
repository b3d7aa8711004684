"""From events to hashes, and the SQL functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import hashing
from plumbline.operators import canonical, canonical_tree
from plumbline.schema import ALGORITHMS, Options
from plumbline.sources import documents


def hash_events(events: DataFrame, options: Options | None = None) -> DataFrame:
    """events with a column for each output of the options, without events that have nothing to hash. One narrow stage: no shuffle."""
    options = options or Options()
    df = canonical.prehash(events, options, drop_empty=True)
    outs = hashing.outputs(F.col("__p"), options.algorithms, join=options.join, version=options.version, strict=options.strict)
    return df.withColumnRenamed("prehash", "__p").select(*[c for c in df.columns if c != "prehash"], *[c.alias(name) for name, c in outs.items()])


def hash_one(spark: SparkSession, event_json: str, namespaces: dict[str, str] | None = None, options: Options | None = None) -> dict[str, str]:
    """The outputs of a single event."""
    options = options or Options()
    df = spark.createDataFrame([("", 0, event_json, namespaces or {})], "source_file string, event_ord int, event_json string, namespaces map<string,string>")
    row = hash_events(df, options).first()
    return {x: row[x] for x in options.algorithms} if row else {}


def register(spark: SparkSession) -> None:
    """SQL functions event_prehash(json, namespaces, version), event_hash(json, namespaces, algorithm, version), for which an unknown
    algorithm means sha-256, and the table function explode_events(document, format): event_ord, event_json, namespaces.

    namespaces: a map, or null. A null or bad event has null for both; version: 2.0 or 2.1.
    """
    excluded = Options().excluded()

    def one(text: str | None, namespaces: list | None, version: str) -> str | None:
        try:
            return canonical_tree.prehash(text or "", dict(namespaces or []), excluded, version).replace("\n", "").replace("\r", "")
        except (ValueError, TypeError, RecursionError):
            return None

    def event_prehash(text: pa.Array, namespaces: pa.Array, version: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(text.to_pylist(), namespaces.to_pylist(), version.to_pylist(), strict=True)], pa.string())

    spark.udf.register("event_prehash", F.arrow_udf(event_prehash, "string"))
    cases = " ".join(f"WHEN '{x}' THEN {hashing.digest_sql('p', x)}" for x in ALGORITHMS)
    known = ", ".join(f"'{x}'" for x in ALGORITHMS)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION event_digest(p STRING, a STRING, v STRING) RETURNS STRING
        RETURN CASE WHEN p IS NOT NULL THEN concat('ni:///', CASE WHEN lower(a) IN ({known}) THEN lower(a) ELSE 'sha-256' END, ';', CASE lower(a) {cases} ELSE sha2(p, 256) END, '?ver=CBV', v) END""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION event_hash(j STRING, n MAP<STRING, STRING>, a STRING, v STRING) RETURNS STRING
        RETURN event_digest(event_prehash(j, n, v), a, v)""")

    class ExplodeEvents:
        def eval(self, document: str, format: str):
            for i, (event, ns) in enumerate(documents.document_events(document or "", format)):
                yield i, event, ns

    spark.udtf.register("explode_events", F.udtf(ExplodeEvents, returnType="event_ord int, event_json string, namespaces map<string,string>"))
