"""Columns of raw records made into an event's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("null", "zero")
#: How numbers are written; Spark's own casts also take type suffixes such as 1.0d, and NaN.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def as_double(c: Column) -> Column:
    """Null where the text is no number; NaN is none."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def as_int(c: Column) -> Column:
    """0 where the text is no number, or one beyond the type; else cut to an integer."""
    return F.coalesce(as_double(c).try_cast("int"), F.lit(0))


def filled(c: Column, missing: str = "null") -> Column:
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}, not {missing!r}")
    return F.coalesce(c, F.lit(0.0)) if missing == "zero" else c


def carrier(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def hour(hhmm: Column) -> Column:
    """Of a time written as HHMM; 2400 is the same day's midnight."""
    x = F.when(hhmm == 2400, 0).otherwise(hhmm)
    return F.pmod(F.floor(x / 100), F.lit(24)).cast("int")


def minute(hhmm: Column) -> Column:
    return F.pmod(F.when(hhmm == 2400, 0).otherwise(hhmm), F.lit(100)).cast("int")


def month(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)), F.lit(12))


def day(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))


def _moment(y: Column, m: Column, d: Column, h: Column, mi: Column) -> Column:
    return F.when(y >= 1, F.try_make_timestamp_ntz(y, m, d, h, mi, F.lit(0).cast("decimal(16,6)")))


def scheduled(year: Column, month_: Column, day_: Column, hhmm: Column) -> Column:
    """The scheduled departure; null if there is no such date or minute."""
    return _moment(year, month(month_), day(day_), hour(hhmm), minute(hhmm))


def event_time(year: Column, month_: Column, day_: Column, hhmm: Column) -> Column:
    """The scheduled departure, else the first of its month; null without a year."""
    return F.coalesce(scheduled(year, month_, day_, hhmm), _moment(year, month(month_), F.lit(1), F.lit(0), F.lit(0)))


def epoch_millis(moment: Column) -> Column:
    """The session's time zone must be UTC."""
    return F.unix_millis(moment.cast("timestamp"))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def csv_line(*columns: Column) -> Column:
    """Comma-joined, null as nothing, no quotes."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
