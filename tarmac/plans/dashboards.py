"""What dashboards ask of Q1's rows: series over a time range, in columns or in long form, and a legend for each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ordered import numbered

SERIES = ("num_flights", "dep_delay_mean", "cancellation_rate", "late_departure_rate")
#: Fields of a point beside its time and its tag.
FIELDS = ("num_flights", "completed", "cancelled", "diverted", "dep_delay_mean", "cancellation_rate", "late_departure_rate")


def ranged(status: DataFrame, start: str, end: str) -> DataFrame:
    """Windows from ``start`` up to ``end``, that one left out."""
    return status.filter((F.col("window_start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("window_start") < F.lit(end).cast("timestamp_ntz")))


def _day() -> Column:
    return F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / 86400)


def series(status: DataFrame, field: str, start: str, end: str) -> DataFrame:
    """time, metric, value, and the position by time, then metric: the order in which a dashboard draws them."""
    if field not in FIELDS:
        raise ValueError(f"no series {field!r}")
    points = ranged(status, start, end).select(F.col("window_start").alias("time"), F.col("airline").alias("metric"), F.col(field).alias("value"))
    return numbered(points, _day(), ["time", "metric"], "position")


def long(status: DataFrame, start: str, end: str, fields: tuple[str, ...] = SERIES) -> DataFrame:
    """time, airline, field, value, position by time; nulls make no point."""
    wide = ranged(status, start, end).select(F.col("window_start").alias("time"), "airline", *[F.col(f).cast("double").alias(f) for f in fields])
    points = wide.unpivot(["time", "airline"], list(fields), "field", "value").filter("value IS NOT NULL")
    return numbered(points, _day(), ["time", "airline", "field"], "position")


def legend(points: DataFrame) -> DataFrame:
    """Of each series its last value, its greatest and its number of points."""
    return points.groupBy("airline", "field").agg(F.max_by("value", "time").alias("last_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("points"))


def lines(status: DataFrame, measurement: str = "q1") -> DataFrame:
    """Points as text: measurement,tag fields time in nanoseconds; a null field is left out."""
    ints = {"num_flights", "completed", "cancelled", "diverted"}
    fields = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.lit("i" if f in ints else "")) for f in FIELDS])
    tag = F.regexp_replace("airline", r"([,= ])", r"\\$1")
    return status.select(F.concat_ws(" ", F.concat(F.lit(f"{measurement},airline="), tag), fields, F.concat(F.unix_seconds(F.col("window_start").cast("timestamp")).cast("string"), F.lit("000000000"))).alias("line"))
