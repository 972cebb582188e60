"""Provider health over a stream of attempts: counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(attempts: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """provider, start, attempts, failed and mean_ms for each window; the same for a stream, where
    rows later than ``late`` are dropped and a window's state goes once the watermark has passed it,
    and for a table."""
    return (
        attempts.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy("provider", F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
        .select("provider", F.col("w.start").alias("start"), "attempts", "failed", "mean_ms")
    )
