"""Tumbling report windows over change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes_per_window(events: DataFrame, time: str = "fetched_at", width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Event counts per window and severity; the same call serves batch and stream."""
    moment = F.col(time).cast("timestamp")
    timed = events.withColumn("_at", moment)
    if events.isStreaming:
        timed = timed.withWatermark("_at", lateness)
    counts = timed.groupBy(F.window("_at", width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("changes"))
    return counts.select(F.col("w.start").alias("window_start"), "severity", "changes")
