"""Event-time counts of series as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_rates(events: DataFrame, delay: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """(series, start, end, n, rate) of each event type's buckets; a bucket is final once the watermark is past it.

    `events` is a stream or a batch of (ts, event_type, value).
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = stamped.groupBy(F.window("ts", width), F.col("event_type").alias("series")).agg(
        F.count("*").alias("n"), (F.sum(F.floor(F.col("value") * 100 + 0.5)) / (F.count("*") * 100.0)).alias("rate")
    )
    return grouped.select("series", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rate")
