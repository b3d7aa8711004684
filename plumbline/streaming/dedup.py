"""Streams of events: hashing is stateless; duplicates are dropped by hash within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.hashing import hash_events
from plumbline.schema import Options


def hash_stream(events: DataFrame, options: Options | None = None) -> DataFrame:
    return hash_events(events, options)


def dedup_stream(hashed: DataFrame, *, hash_id: str = "sha-256", event_time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """The first event of each hash; state is kept for the delay only."""
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([hash_id])


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.try_to_timestamp(F.get_json_object("event_json", "$.eventTime")))
