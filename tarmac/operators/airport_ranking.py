"""Q2: airports ranked by severe departure delays in each window.

Stage one counts each airport's completed flights, drops airports with few, and lists the worst delays; stage two ranks the airports of each window. Ties go to the higher mean delay, then to the lower airport id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import bounded, flags
from tarmac.functions.windows import tumble

LISTED, RANKED, LEAST = 20, 10, 30


def delay_list(entries: Column) -> Column:
    """[(airline,dest,delay),...] of an array of structs; [] of none."""
    one = lambda e: F.format_string("(%s,%d,%.2f)", e["airline"], e["dest"], e["delay"])
    return F.concat(F.lit("["), F.array_join(F.transform(entries, one), ","), F.lit("]"))


def _entry() -> Column:
    """Worst first in ascending order; null unless severely delayed and of a known airline."""
    entry = F.struct((-F.col("dep_delay")).alias("order"), "airline", F.coalesce("dest_airport_id", F.lit(0)).alias("dest"), F.col("dep_delay").alias("delay"))
    return F.when(flags.severe() & F.col("airline").isNotNull(), entry)


def numbers() -> list[Column]:
    return [F.count(F.lit(1)).alias("num_flights"), F.count_if(flags.severe()).alias("severe_delays"), F.avg("dep_delay").alias("dep_delay_mean"), F.max("dep_delay").alias("dep_delay_max")]


def _completed(flights: DataFrame) -> DataFrame:
    return flights.filter(flags.eos_safe(flags.completed()) if flights.isStreaming else flags.completed())


def airports(flights: DataFrame, size: str, least: int = LEAST) -> DataFrame:
    """Stage one without the list."""
    return tumble(_completed(flights), size, ["origin_airport_id"], numbers()).filter(F.col("num_flights") >= least)


def worst(flights: DataFrame, size: str, listed: int = LISTED) -> DataFrame:
    """window_start, origin_airport_id, delayed_flights, of airports with severe delays. No group holds more than ``listed`` of them."""
    rows = _completed(flights).withColumn("entry", _entry()).filter("entry IS NOT NULL")
    return tumble(rows, size, ["origin_airport_id"], [delay_list(bounded.least(F.col("entry"), listed)).alias("delayed_flights")]).drop("window_end")


def _order() -> list[Column]:
    return [F.desc("severe_delays"), F.desc(F.coalesce("dep_delay_mean", F.lit(0.0))), F.asc("origin_airport_id")]


def _listed(flights: DataFrame, size: str, least: int, listed: int) -> DataFrame:
    """Stage one with the list, in one aggregate."""
    grouped = _completed(flights).groupBy(F.window("rowtime", size).alias("window"), "origin_airport_id")
    return grouped.agg(*numbers(), delay_list(bounded.least(_entry(), listed)).alias("delayed_flights")).filter(F.col("num_flights") >= least)


def ranking(flights: DataFrame, size: str, least: int = LEAST, ranked: int = RANKED, listed: int = LISTED) -> DataFrame:
    """ts, airport_rank 1.., and stage one's columns: batch. Flights are shuffled once, as one row for each airport and window of a task."""
    rank = F.row_number().over(Window.partitionBy("window").orderBy(*_order()))
    top = _listed(flights, size, least, listed).withColumn("airport_rank", rank.cast("long")).filter(F.col("airport_rank") <= ranked)
    return top.select(F.col("window.start").alias("ts"), "airport_rank", "origin_airport_id", "num_flights", "severe_delays", "dep_delay_mean", "dep_delay_max", "delayed_flights")


def ranking_stream(flights: DataFrame, size: str, least: int = LEAST, ranked: int = RANKED, listed: int = LISTED) -> DataFrame:
    """The same of a watermarked stream, where row numbers are not allowed: a second aggregation over the closed window sorts its airports. State holds ``listed`` delays of an airport and ``ranked`` airports of a window. Also right on batch."""
    airport = F.struct(
        (-F.col("severe_delays")).alias("a"), (-F.coalesce("dep_delay_mean", F.lit(0.0))).alias("b"), "origin_airport_id",
        "num_flights", "severe_delays", "dep_delay_mean", "dep_delay_max", "delayed_flights",
    )
    second = _listed(flights, size, least, listed).groupBy("window").agg(bounded.least(airport, ranked).alias("top"))
    return second.select(F.col("window.start").alias("ts"), F.posexplode("top").alias("at", "x")).select(
        "ts", (F.col("at") + 1).cast("long").alias("airport_rank"), "x.origin_airport_id", "x.num_flights", "x.severe_delays", "x.dep_delay_mean", "x.dep_delay_max", "x.delayed_flights"
    )
