"""The cache with a lifetime as a stream: an extension, beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_entries(entries: DataFrame, lifetime: str = "1 day") -> DataFrame:
    """First entry of each key within its lifetime, of a stream (key, created_at timestamp, ...); state is bounded by the watermark."""
    return entries.withWatermark("created_at", lifetime).dropDuplicatesWithinWatermark(["key"])


def hit_counts(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries of each key by window."""
    return entries.withWatermark("created_at", late).groupBy(F.window("created_at", window), "key").agg(F.count("*").alias("n"))
