"""Coalescing of event bursts on streams: quiet time closes a burst, a watermark bounds late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, quiet: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of bursts in a stream or batch of events (user_id, ts)."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
