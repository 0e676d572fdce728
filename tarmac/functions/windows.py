"""Tumbling windows aligned to the epoch, and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, SIX_HOURS, GLOBAL = "1 hour", "6 hours", "365 days"


def tumble(df: DataFrame, size: str, by: list[Column | str], aggregates: list[Column], rowtime: str = "rowtime") -> DataFrame:
    """window_start, window_end, ``by`` and ``aggregates`` of each window that has rows."""
    grouped = df.groupBy(F.window(rowtime, size).alias("window"), *by).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def interval(seconds: int) -> str:
    """A duration as Spark writes it."""
    if seconds < 0:
        raise ValueError(f"a delay can't be negative: {seconds}")
    for size, unit in ((3600, "hours"), (60, "minutes")):
        if seconds and seconds % size == 0:
            return f"{seconds // size} {unit}"
    return f"{seconds} seconds"


def watermarked(df: DataFrame, seconds: int, rowtime: str = "rowtime") -> DataFrame:
    return df.withColumn(rowtime, F.col(rowtime).cast("timestamp")).withWatermark(rowtime, interval(seconds))
