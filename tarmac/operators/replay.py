"""Replay of history with controlled out-of-order delivery.

Event times never change; some events are delivered late. Which ones and by how much comes from a seeded arithmetic hash of the event's number, so a disorder can be repeated in any engine. Delays are in event time, in which the acceleration of a replay cancels out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import flags
from tarmac.functions.prepare import epoch_millis
from tarmac.operators.ordered import highest_before, numbered, stretch_of

DISTRIBUTIONS = ("uniform", "exponential")
_MODULUS = 2147483648
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Disorder:
    """``mean``: of the exponential delays, a third of the greatest delay unless given. ``flush_interval``, ``log_interval``: events between two flushes and two lines of the log, where a producer sends them one by one."""

    probability: float = 0.3
    delay: float = 120.0
    distribution: str = "exponential"
    mean: float | None = None
    seed: int = 42
    acceleration: float = 57_600.0
    flush_interval: int = 5_000
    log_interval: int = 100_000

    def __post_init__(self):
        if not 0 <= self.probability <= 1:
            raise ValueError("the probability of holding back must be between 0 and 1")
        if self.acceleration <= 0:
            raise ValueError("the acceleration must be above 0")
        if self.distribution not in DISTRIBUTIONS:
            raise ValueError(f"the distribution must be one of {DISTRIBUTIONS}")
        if self.delay < 0:
            raise ValueError("the greatest delay can't be negative")
        if self.flush_interval <= 0 or self.log_interval <= 0:
            raise ValueError("the intervals of flushing and logging must be above 0")
        if self.distribution == "exponential" and self.mean is not None and self.mean <= 0:
            raise ValueError("the mean delay must be above 0")

    @property
    def mean_delay(self) -> float:
        return self.delay / 3 if self.mean is None else self.mean


def uniform(number: Column, seed: int, multiplier: int) -> Column:
    """In [0, 1), by the event's number."""
    return F.pmod(F.pmod(number, F.lit(_MODULUS)) * multiplier + seed * 12345, F.lit(_MODULUS)) / float(_MODULUS)


def held(d: Disorder, number: str = "event_id") -> Column:
    return uniform(F.col(number), d.seed, 1103515245) < d.probability


def delay_seconds(d: Disorder, number: str = "event_id") -> Column:
    if d.delay <= 0:
        return F.lit(0.0)
    u = uniform(F.col(number), d.seed, 69069)
    return u * d.delay if d.distribution == "uniform" else F.least(-d.mean_delay * F.log(1.0 - u), F.lit(d.delay))


def schedule(flights: DataFrame, d: Disorder) -> DataFrame:
    """``flights`` with event_ms, held, delay_ms, arrival_ms (both in event time) and wall_ms since the first arrival at the acceleration."""
    back = held(d)
    delay = F.when(F.col("held"), F.floor(delay_seconds(d) * 1000)).otherwise(F.lit(0)).cast("long")
    out = flights.withColumn("event_ms", epoch_millis(F.col("rowtime"))).withColumn("held", back).withColumn("delay_ms", delay).withColumn("arrival_ms", F.col("event_ms") + F.col("delay_ms"))
    return out.withColumn("wall_ms", F.col("arrival_ms") / d.acceleration)


#: At one arrival time, events that were held back come first.
ARRIVAL = ["arrival_ms", "not_held", "event_id"]


def _arriving(scheduled: DataFrame) -> tuple[DataFrame, Column]:
    rows = scheduled.withColumn("not_held", ~F.col("held"))
    # numbers of events stay far below 2^61
    return rows, stretch_of(rows, F.col("arrival_ms"), F.when(F.col("not_held"), F.lit(1 << 61)).otherwise(F.lit(0)) + F.col("event_id"))


def delivered(scheduled: DataFrame) -> DataFrame:
    """With ``position``, from 1, in the order of arrival."""
    rows, stretch = _arriving(scheduled)
    return numbered(rows, stretch, ARRIVAL, "position").drop("not_held")


def watched(scheduled: DataFrame) -> DataFrame:
    """With ``highest_ms``: the latest event time that arrived before."""
    rows, stretch = _arriving(scheduled)
    return highest_before(rows, stretch, ARRIVAL, "event_ms", "highest_ms").drop("not_held")


def out_of_order(scheduled: DataFrame) -> DataFrame:
    """One row: events, held, out_of_order (older than what arrived before)."""
    return watched(scheduled).agg(F.count(F.lit(1)).alias("events"), F.count_if("held").alias("held"), F.count_if(F.col("event_ms") < F.col("highest_ms")).alias("out_of_order"))


def too_late(watermark_seconds: float, window_ms: int = HOUR_MS) -> Column:
    """Whether an event's window had closed when it arrived, by a watermark that follows every event."""
    closes = (F.floor(F.col("event_ms") / window_ms) + 1) * window_ms
    return F.coalesce(F.col("highest_ms") - F.lit(int(watermark_seconds * 1000)) >= closes, F.lit(False))


def lateness(scheduled: DataFrame, watermark_seconds: float, window_ms: int = HOUR_MS) -> DataFrame:
    """With ``late``: see ``too_late``."""
    return watched(scheduled).withColumn("late", too_late(watermark_seconds, window_ms))


def loss(flights: DataFrame, d: Disorder, watermark_seconds: float, airlines: tuple[str, ...] = flags.AIRLINES) -> DataFrame:
    """Per airline: events of its airlines, and those that came too late."""
    late = lateness(schedule(flights, d), watermark_seconds).filter(flags.of_airlines(airlines))
    return late.groupBy("airline").agg(F.count(F.lit(1)).alias("events"), F.count_if("late").alias("late_events"))
