"""Log activity in event-time windows; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(logs: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """window_start, op, n, total_ms."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if logs.isStreaming and late:
        rows = rows.withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", width), "op").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "op", "n", "total_ms")


def sliding(logs: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """window_start, n."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if logs.isStreaming and late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


def sessions(logs: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """job_id, session_start, session_end (of the last log), n."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp"))
    if logs.isStreaming and late:
        rows = rows.withWatermark("ts", late)
    sums = rows.groupBy("job_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return sums.select("job_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), "n")
