"""Sinks: text and JSON of hashes, and files beside their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(outputs: list[str]) -> Column:
    return F.to_json(F.create_map(*[x for name in outputs for x in (F.lit(name), F.col(f"`{name}`"))]))


def as_text(outputs: list[str]) -> Column:
    """One value a line, in the order of outputs."""
    return F.concat_ws("\n", *[F.col(f"`{x}`") for x in outputs])


def write_batch(hashed: DataFrame, path: str, outputs: list[str]) -> None:
    """.prehashes and .hashes for each source file: folders path/<kind>/source=<name>, one value a line in the order of events."""
    name = F.element_at(F.split("source_file", "/"), -1)
    shown = [x for x in outputs if x.lower() == "prehash"]
    for kind, columns in (("prehashes", shown), ("hashes", [x for x in outputs if x not in shown])):
        if columns:
            rows = hashed.select(name.alias("source"), as_text(columns).alias("value"), "source_file", "event_ord")
            rows.repartition("source").sortWithinPartitions("source", "source_file", "event_ord").select("source", "value").write.partitionBy("source").text(f"{path}/{kind}")
