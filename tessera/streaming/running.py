"""An extension: the grouped maximum as a stream, for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_max(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, max_value) over all rows so far; write it in update or complete mode."""
    return stream.groupBy(key).agg(F.max(value).alias("max_value"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n) per tumbling window, with late rows accepted up to a watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
