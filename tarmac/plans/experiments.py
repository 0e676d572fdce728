"""The experiments: how the watermark's delay trades latency against completeness."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import flags
from tarmac.operators.replay import Disorder, schedule, too_late, watched


@dataclass(frozen=True)
class Experiment:
    name: str
    disorder: Disorder
    watermark_seconds: int


# Disorder and watermark delay of each experiment.
EXPERIMENTS = (
    Experiment("base", Disorder(0.3, 120, "exponential", 40), 180),
    Experiment("01_baseline", Disorder(0.0, 0, "uniform"), 30),
    Experiment("02_ooo_safe", Disorder(0.3, 120, "exponential", 40), 180),
    Experiment("03_ooo_late_loss", Disorder(0.3, 120, "exponential", 40), 30),
    Experiment("04_ooo_uniform_late_loss", Disorder(0.3, 120, "uniform"), 30),
    Experiment("05_wm_safe", Disorder(0.3, 3600, "uniform"), 3600),
    Experiment("06_wm_aggressive", Disorder(0.3, 3600, "uniform"), 300),
)


def completeness(flights: DataFrame, experiments: tuple[Experiment, ...] = EXPERIMENTS, airlines: tuple[str, ...] = flags.AIRLINES) -> DataFrame:
    """experiment, events, held_events, late_events: of the given airlines' events."""

    alike: dict[Disorder, list[Experiment]] = {}
    for e in experiments:
        alike.setdefault(e.disorder, []).append(e)

    def one(d: Disorder, own: list[Experiment]) -> DataFrame:
        """Experiments of one disorder differ in their watermark only: one pass serves them all."""
        rows = watched(schedule(flights, d)).filter(flags.of_airlines(airlines))
        counts = rows.agg(F.count(F.lit(1)).alias("events"), F.count_if("held").alias("held_events"), *[F.count_if(too_late(e.watermark_seconds)).alias(f"late{i}") for i, e in enumerate(own)])
        each = F.array(*[F.struct(F.lit(e.name).alias("experiment"), F.col(f"late{i}").alias("late_events")) for i, e in enumerate(own)])
        return counts.select("events", "held_events", F.inline(each)).select("experiment", "events", "held_events", "late_events")

    return reduce(DataFrame.unionByName, [one(d, own) for d, own in alike.items()])


def expected_loss(d: Disorder, watermark_seconds: float, window_seconds: float = 3600) -> float:
    """The share of events lost to uniform delays if events came evenly: p (D - d)^2 / (2 D W). A model; measured losses differ."""
    over = max(0.0, d.delay - watermark_seconds)
    return d.probability * over * over / (2 * d.delay * window_seconds) if d.delay else 0.0


def compared(complete: DataFrame, other: DataFrame) -> DataFrame:
    """One row: keys, equal keys, missing keys and flights lost of Q1's rows under another watermark."""
    keys = ["window_start", "airline"]
    # means are sums in some order of rows, so their last digits don't count
    values = F.struct(*[F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in complete.dtypes])
    both = complete.select(*keys, F.col("num_flights").alias("all_flights"), values.alias("a")).join(other.select(*keys, F.col("num_flights").alias("seen_flights"), values.alias("b")), keys, "full")
    return both.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal_keys"), F.count_if(F.col("b").isNull()).alias("missing_keys"),
        (F.sum("all_flights") - F.coalesce(F.sum("seen_flights"), F.lit(0))).alias("lost_flights"),
    )
