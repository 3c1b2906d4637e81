"""Windows over a stream of events: an extension, for tables that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Entries and value by kind and window of time; rows later than ``late`` behind the newest are left out of a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one with a zone
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.floor(F.sum("value") * 100 + 0.5).alias("cents"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once by id, in a stream within the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
