"""Predicates over an event's nullable flags and delays. A missing flag means "did not happen"; a missing delay is never late."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATE_MINUTES, SEVERE_MINUTES = 15.0, 30.0
AIRLINES = ("AA", "DL", "UA", "WN")


def _set(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(0.0)) >= 0.5


def cancelled() -> Column:
    return _set("cancelled")


def diverted() -> Column:
    return _set("diverted")


def completed() -> Column:
    return ~cancelled() & ~diverted()


def late(minutes: float = LATE_MINUTES) -> Column:
    return ~cancelled() & (F.col("dep_delay") > minutes)


def severe(minutes: float = SEVERE_MINUTES) -> Column:
    return F.col("dep_delay") > minutes


def of_airlines(airlines: tuple[str, ...] = AIRLINES) -> Column:
    return F.col("airline").isin(*airlines)


def eos_safe(predicate: Column, rowtime: str = "rowtime") -> Column:
    """``predicate`` tied to the event time, so that the optimizer leaves it above the watermark: an end-of-stream row then still moves the watermark before it is filtered out."""
    return F.when(F.col(rowtime).isNull(), F.lit(False)).otherwise(predicate)
