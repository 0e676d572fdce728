"""Q1: the hourly status of each airline.

Three forms agree: DataFrame, SQL, and mergeable partial counts that are kept by chunk and merged later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import flags
from tarmac.functions.windows import HOUR, tumble


def counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("num_flights"), F.count_if(flags.completed()).alias("completed"),
        F.count_if(flags.cancelled()).alias("cancelled"), F.count_if(flags.diverted()).alias("diverted"),
    ]


def mean_delay() -> Column:
    return F.avg(F.when(~flags.cancelled(), F.col("dep_delay")))


def rate(part: Column, whole: Column) -> Column:
    """Percent; null of nothing."""
    return part.cast("double") * 100.0 / F.nullif(whole, F.lit(0))


def status(flights: DataFrame, airlines: tuple[str, ...] = flags.AIRLINES, size: str = HOUR) -> DataFrame:
    """Of batch and stream alike; ``flights`` must be watermarked if it is a stream."""
    chosen = flights.filter(flags.eos_safe(flags.of_airlines(airlines)) if flights.isStreaming else flags.of_airlines(airlines))
    return tumble(
        chosen, size, ["airline"],
        [*counts(), mean_delay().alias("dep_delay_mean"), rate(F.count_if(flags.cancelled()), F.count(F.lit(1))).alias("cancellation_rate"),
         rate(F.count_if(flags.late()), F.count_if(~flags.cancelled())).alias("late_departure_rate")],
    )


def status_sql(flights: DataFrame, airlines: tuple[str, ...] = flags.AIRLINES, size: str = HOUR) -> DataFrame:
    return flights.sparkSession.sql(
        """
        WITH known AS (
            SELECT window(rowtime, :size) AS w, airline, dep_delay,
                   coalesce(cancelled >= 0.5, false) AS off, coalesce(diverted >= 0.5, false) AS away
            FROM {flights} WHERE array_contains(split(:airlines, ','), airline)
        ), counted AS (
            SELECT w, airline, count(*) AS num_flights, count_if(NOT off AND NOT away) AS completed, count_if(off) AS cancelled,
                   count_if(away) AS diverted, avg(dep_delay) FILTER (WHERE NOT off) AS dep_delay_mean,
                   count_if(NOT off AND dep_delay > 15) AS late
            FROM known GROUP BY w, airline
        )
        SELECT w.start AS window_start, w.end AS window_end, airline, num_flights, completed, cancelled, diverted, dep_delay_mean,
               cancelled * 100.0D / num_flights AS cancellation_rate,
               late * 100.0D / nullif(num_flights - cancelled, 0) AS late_departure_rate
        FROM counted
        """,
        {"size": size, "airlines": ",".join(airlines)},
        flights=flights,
    )


def partials(flights: DataFrame, airlines: tuple[str, ...] = flags.AIRLINES, size: str = HOUR, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts that add up: of one chunk of flights, or of each value of ``by``."""
    delay = F.when(~flags.cancelled(), F.col("dep_delay"))
    sums = [*counts(), F.count_if(flags.late()).alias("late"), F.sum(delay).alias("delay_sum"), F.count(delay).alias("delay_count")]
    chosen = flags.eos_safe(flags.of_airlines(airlines)) if flights.isStreaming else flags.of_airlines(airlines)
    return tumble(flights.filter(chosen), size, ["airline", *by], sums)


def merged(parts: DataFrame) -> DataFrame:
    """The status out of partials of any number of chunks."""
    sums = [F.sum(c).alias(c) for c in ("num_flights", "completed", "cancelled", "diverted", "late", "delay_sum", "delay_count")]
    return finished(parts.groupBy("window_start", "window_end", "airline").agg(*sums))


def finished(total: DataFrame) -> DataFrame:
    """The status out of whole windows' sums."""
    return total.select(
        "window_start", "window_end", "airline", "num_flights", "completed", "cancelled", "diverted",
        (F.col("delay_sum") / F.nullif(F.col("delay_count"), F.lit(0))).alias("dep_delay_mean"),
        rate(F.col("cancelled"), F.col("num_flights")).alias("cancellation_rate"),
        rate(F.col("late"), F.col("num_flights") - F.col("cancelled")).alias("late_departure_rate"),
    )
