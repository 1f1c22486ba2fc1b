"""Structured Streaming forms of the series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(stream: DataFrame, step: int, late: str = "1 day", how: str = "mean", key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """Buckets of ``step`` seconds of a stream; readings later than ``late`` behind the newest are no longer counted, and then a bucket is final."""
    reduced = {"sum": F.sum, "mean": F.avg}[how](value)
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(key, F.window("_ts", f"{step} seconds")).agg(reduced.alias("value"), F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("ts"), "value", "n")
