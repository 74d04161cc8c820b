"""Streams of events: repeats dropped within a watermark, and counts per session and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Each combination of the keys once within the time that late rows are waited for."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def rolling_counts(events: DataFrame, window: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Events and failures per session and window of event time."""
    return (
        events.withWatermark("ts", within)
        .groupBy(F.window("ts", window), "session_id")
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_failure").alias("n_failures"))
        .select("session_id", F.col("window.start").alias("start"), "n_events", "n_failures")
    )
