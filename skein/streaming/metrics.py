"""Fetch metrics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.stats import duration_histogram_columns


def fetch_metrics(log: DataFrame, event_time: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Hourly counts and cumulative duration buckets per fetch status."""
    return (
        log.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 hour").alias("w"), "status")
        .agg(*duration_histogram_columns(F.col("duration_s")))
        .withColumn("hour", F.unix_seconds(F.col("w.start")))
        .drop("w")
    )
