"""Every query over the driver's tables, and the SQL that each is held against.

Derived doubles are rounded to six digits on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import flags, prepare
from tarmac.functions.windows import GLOBAL, HOUR, SIX_HOURS, tumble
from tarmac.operators import airline_status, airport_ranking, merge, replay
from tarmac.operators.ordered import numbered, stretch_of
from tarmac.plans import dashboards, experiments
from tarmac.schema import Q1, RAW_DOUBLE, RAW_INT
from tarmac.sources import avro
from tarmac.sources import flights as source
from tarmac.sources.flights import EVENT_AIRLINES
from tarmac.sources.streams import end_of_stream
from tarmac.streaming import jobs, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fewest flights of a ranked airport: the tables are too small for 30 in short windows.
LEAST = {HOUR: 2, SIX_HOURS: 2, GLOBAL: 30}
RANGE = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
DISORDER = replay.Disorder(0.3, 3600, "uniform", seed=42)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, in a session whose times are UTC."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL that oracles share

FLIGHTS = """flights AS (
    SELECT event_id, ts AS rowtime, event_type AS airline, CAST(user_id AS INT) AS origin_airport_id, CAST(event_id % 97 AS INT) AS dest_airport_id,
           CASE WHEN event_id % 13 = 0 THEN NULL ELSE value - 10.0 END AS dep_delay,
           CAST(CASE WHEN event_id % 17 = 0 THEN 1.0 WHEN event_id % 19 = 0 THEN NULL ELSE 0.0 END AS DOUBLE) AS cancelled,
           CAST(CASE WHEN event_id % 23 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS diverted
    FROM events)"""
RAW = r"""raw AS (
    SELECT event_id, event_type, value,
           CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'x' ELSE '2025' END AS y,
           CAST(event_id % 15 AS VARCHAR) AS m, CAST(event_id % 33 AS VARCHAR) AS d,
           CASE WHEN event_id % 41 <> 0 THEN '  ' || event_type || chr(9) || ' ' END AS carrier,
           CASE WHEN event_id % 43 = 0 THEN 'bad' WHEN event_id % 59 = 0 THEN 'NaN' WHEN event_id % 61 = 0 THEN '1e12' ELSE CAST(user_id AS VARCHAR) END AS origin,
           CASE WHEN event_id % 67 = 0 THEN 'inf' WHEN event_id % 71 = 0 THEN '12f' ELSE CAST(event_id % 97 AS VARCHAR) || '.7' END AS dest,
           CASE WHEN event_id % 47 <> 0 THEN CASE WHEN event_id % 50 = 1 THEN '2400' ELSE CAST((event_id * 37) % 2401 AS VARCHAR) END END AS crs,
           CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 53 = 0 THEN 'n/a' WHEN event_id % 73 = 0 THEN 'NaN' WHEN event_id % 79 = 0 THEN '1.0d' WHEN event_id % 83 = 0 THEN ' -1.5e1' || chr(9) ELSE CAST(value AS VARCHAR) END AS delay,
           CASE WHEN event_id % 17 = 0 THEN '1.00' WHEN event_id % 19 <> 0 THEN '0.00' END AS cancelled,
           CASE WHEN event_id % 23 = 0 THEN '1.00' ELSE '0.00' END AS diverted
    FROM events)"""


def double_sql(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '\\s*[+-]?[0-9]*[.]?[0-9]*([eE][+-]?[0-9]+)?\\s*') THEN TRY_CAST(trim({text}, ' ' || chr(9)) AS DOUBLE) END"


def int_sql(text: str) -> str:
    return f"coalesce(TRY_CAST(trunc({double_sql(text)}) AS INT), 0)"


INTS = f"""ints AS (
    SELECT *, {int_sql('y')} AS year, {int_sql('m')} AS month, {int_sql('d')} AS day_of_month, {int_sql('origin')} AS origin_airport_id, {int_sql('dest')} AS dest_airport_id, {int_sql('crs')} AS crs_dep_time
    FROM raw)"""
PARTS = """parts AS (
    SELECT *, CASE WHEN crs_dep_time = 2400 THEN 0 ELSE (crs_dep_time // 100) % 24 END AS hour, CASE WHEN crs_dep_time = 2400 THEN 0 ELSE crs_dep_time % 100 END AS minute,
           least(greatest(month, 1), 12) AS mm, greatest(day_of_month, 1) AS dd
    FROM ints)"""
TIMES = """times AS (
    SELECT *, CASE WHEN year >= 1 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:00', year, mm, dd, hour, minute) AS TIMESTAMP) END AS scheduled,
           CASE WHEN year >= 1 THEN TRY_CAST(printf('%04d-%02d-01 00:00:00', year, mm) AS TIMESTAMP) END AS month_start
    FROM parts)"""
PREPARED = f"{RAW}, {INTS}, {PARTS}, {TIMES}"
IN_LIST = "('click', 'view', 'error', 'purchase')"
OFF, AWAY = "coalesce(cancelled, 0.0) >= 0.5", "coalesce(diverted, 0.0) >= 0.5"


def bucket(size: str) -> str:
    return f"time_bucket(INTERVAL '{size}', rowtime, TIMESTAMP '1970-01-01')"


def status_sql(more: str = "") -> str:
    return f"""q1 AS (
    SELECT {bucket('1 hour')} AS window_start, {bucket('1 hour')} + INTERVAL '1 hour' AS window_end, airline, count(*) AS num_flights,
           count(*) FILTER (WHERE NOT ({OFF}) AND NOT ({AWAY})) AS completed, count(*) FILTER (WHERE {OFF}) AS cancelled, count(*) FILTER (WHERE {AWAY}) AS diverted,
           round(avg(dep_delay) FILTER (WHERE NOT ({OFF})), 6) AS dep_delay_mean, round(count(*) FILTER (WHERE {OFF}) * 100.0::DOUBLE / count(*), 6) AS cancellation_rate,
           round(count(*) FILTER (WHERE NOT ({OFF}) AND dep_delay > 15) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE NOT ({OFF})), 0), 6) AS late_departure_rate
    FROM flights WHERE airline IN {IN_LIST} {more} GROUP BY ALL)"""


Q1_SQL = f"WITH {FLIGHTS}, {status_sql()} "


def airports_sql(size: str) -> str:
    return f"""airports AS (
    SELECT {bucket(size)} AS ts, origin_airport_id, count(*) AS num_flights, count(*) FILTER (WHERE dep_delay > 30) AS severe_delays, avg(dep_delay) AS mean, max(dep_delay) AS dep_delay_max,
           '[' || coalesce(array_to_string(list_slice(list(printf('(%s,%d,%.2f)', airline, dest_airport_id, dep_delay) ORDER BY dep_delay DESC, airline, dest_airport_id) FILTER (WHERE dep_delay > 30), 1, 20), ','), '') || ']' AS delayed_flights
    FROM flights WHERE NOT ({OFF}) AND NOT ({AWAY}) GROUP BY ALL HAVING count(*) >= {LEAST[size]})"""


def ranking_sql(size: str) -> str:
    return f"""WITH {FLIGHTS}, {airports_sql(size)}, q2 AS (
    SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY severe_delays DESC, coalesce(mean, 0.0) DESC, origin_airport_id) AS airport_rank, origin_airport_id, num_flights, severe_delays,
           round(mean, 6) AS dep_delay_mean, round(dep_delay_max, 6) AS dep_delay_max, delayed_flights
    FROM airports QUALIFY airport_rank <= 10) """


# ---------------------------------------------------------------- Q1


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airline_status.status(source.flights(spark, sf_dir), EVENT_AIRLINES)


@query(Q1_SQL + "SELECT * FROM q1")
def q1_airline_status(spark, sf_dir):
    return status(spark, sf_dir)


@query(Q1_SQL + "SELECT * FROM q1")
def q1_sql_airline_status(spark, sf_dir):
    return airline_status.status_sql(source.flights(spark, sf_dir), EVENT_AIRLINES)


@query(Q1_SQL + "SELECT * FROM q1")
def q1_ds_airline_status(spark, sf_dir):
    return airline_status.merged(airline_status.partials(source.flights(spark, sf_dir), EVENT_AIRLINES))


@query(Q1_SQL + "SELECT * FROM q1")
def q1_ds_partial_merge(spark, sf_dir):
    rows = source.flights(spark, sf_dir).withColumn("chunk", F.pmod("event_id", F.lit(4)))
    return airline_status.merged(airline_status.partials(rows, EVENT_AIRLINES, by=("chunk",)))


def _of_q1(name: str, *columns: str):
    def run(spark, sf_dir):
        return status(spark, sf_dir).select("window_start", "airline", *columns)

    run.__name__ = name
    query(Q1_SQL + f"SELECT window_start, airline, {', '.join(columns)} FROM q1")(run)


_of_q1("q1_num_flights", "num_flights")
_of_q1("q1_status_counts", "completed", "cancelled", "diverted")
_of_q1("q1_dep_delay_mean", "dep_delay_mean")
_of_q1("q1_cancellation_rate", "cancellation_rate")
_of_q1("q1_late_rate", "late_departure_rate")


# ---------------------------------------------------------------- Q2


def _ranked(name: str, size: str):
    def run(spark, sf_dir):
        return airport_ranking.ranking(source.flights(spark, sf_dir), size, LEAST[size])

    run.__name__ = name
    query(ranking_sql(size) + "SELECT * FROM q2")(run)


_ranked("q2_rank_1h", HOUR)
_ranked("q2_rank_6h", SIX_HOURS)
_ranked("q2_rank_global", GLOBAL)


@query(f"WITH {FLIGHTS} SELECT {bucket('6 hours')} AS window_start, origin_airport_id, count(*) FILTER (WHERE dep_delay > 30) AS severe_delays FROM flights WHERE NOT ({OFF}) AND NOT ({AWAY}) GROUP BY ALL")
def severe_delay_count(spark, sf_dir):
    rows = source.flights(spark, sf_dir).filter(flags.completed())
    return tumble(rows, SIX_HOURS, ["origin_airport_id"], [F.count_if(flags.severe()).alias("severe_delays")]).drop("window_end")


@query(f"WITH {FLIGHTS} SELECT {bucket('6 hours')} AS window_start, origin_airport_id, round(avg(dep_delay), 6) AS dep_delay_mean, round(max(dep_delay), 6) AS dep_delay_max FROM flights WHERE NOT ({OFF}) AND NOT ({AWAY}) GROUP BY ALL")
def delay_avg_max(spark, sf_dir):
    rows = source.flights(spark, sf_dir).filter(flags.completed())
    return tumble(rows, SIX_HOURS, ["origin_airport_id"], [F.avg("dep_delay").alias("dep_delay_mean"), F.max("dep_delay").alias("dep_delay_max")]).drop("window_end")


@query(f"WITH {FLIGHTS}, {airports_sql(GLOBAL)} SELECT ts AS window_start, origin_airport_id, num_flights FROM airports")
def having_min_flights(spark, sf_dir):
    return airport_ranking.airports(source.flights(spark, sf_dir), GLOBAL, LEAST[GLOBAL]).select("window_start", "origin_airport_id", "num_flights")


@query(f"WITH {FLIGHTS}, {airports_sql(GLOBAL)} SELECT ts AS window_start, origin_airport_id, delayed_flights FROM airports WHERE delayed_flights <> '[]'")
def top_delayed_list(spark, sf_dir):
    few = airport_ranking.airports(source.flights(spark, sf_dir), GLOBAL, LEAST[GLOBAL]).select("window_start", "origin_airport_id")
    return airport_ranking.worst(source.flights(spark, sf_dir), GLOBAL).join(few, ["window_start", "origin_airport_id"], "left_semi")


@query(f"WITH {FLIGHTS} SELECT event_id, round(CASE WHEN dep_delay > 30 THEN dep_delay END, 6) AS severe_delay FROM flights")
def case_when_null(spark, sf_dir):
    return source.flights(spark, sf_dir).select("event_id", F.when(flags.severe(), F.col("dep_delay")).alias("severe_delay"))


# ---------------------------------------------------------------- windows and filters


def _tumbled(name: str, size: str):
    def run(spark, sf_dir):
        return tumble(source.flights(spark, sf_dir), size, [], [F.count(F.lit(1)).alias("events")])

    run.__name__ = name
    query(f"WITH {FLIGHTS} SELECT {bucket(size)} AS window_start, {bucket(size)} + INTERVAL '{size}' AS window_end, count(*) AS events FROM flights GROUP BY ALL")(run)


_tumbled("tumble_1h", HOUR)
_tumbled("tumble_6h", SIX_HOURS)
_tumbled("tumble_global", GLOBAL)


@query("SELECT event_id, epoch_us(ts) // 1000 AS event_time, make_timestamp(epoch_us(ts) // 1000 * 1000) AS rowtime FROM events")
def rowtime_from_millis(spark, sf_dir):
    rows = source.table(spark, sf_dir, "events").select("event_id", prepare.epoch_millis(F.col("ts")).alias("event_time"))
    return rows.withColumn("rowtime", prepare.from_millis(F.col("event_time")).cast("timestamp_ntz"))


@query(f"WITH {FLIGHTS} SELECT event_id, airline FROM flights WHERE airline IN {IN_LIST}")
def filter_in_list(spark, sf_dir):
    return source.flights(spark, sf_dir).filter(flags.of_airlines(EVENT_AIRLINES)).select("event_id", "airline")


@query(f"WITH {FLIGHTS} SELECT event_id, airline, cancelled, diverted FROM flights WHERE NOT ({OFF}) AND NOT ({AWAY})")
def filter_completed(spark, sf_dir):
    return source.flights(spark, sf_dir).filter(flags.completed()).select("event_id", "airline", "cancelled", "diverted")


@query(Q1_SQL + f"SELECT 'q1' AS query, CAST(sum(num_flights) AS BIGINT) AS events FROM q1 UNION ALL SELECT 'q2', count(*) FROM flights WHERE NOT ({OFF}) AND NOT ({AWAY})")
def eos_excluded(spark, sf_dir):
    """What each query counts of the flights and the stream's end: the end counts in neither."""
    both = source.flights(spark, sf_dir).unionByName(end_of_stream(spark).withColumn("rowtime", F.col("rowtime").cast("timestamp_ntz")))
    one = airline_status.status(both, EVENT_AIRLINES).agg(F.lit("q1").alias("query"), F.sum("num_flights").alias("events"))
    two = both.filter(flags.completed()).agg(F.lit("q2").alias("query"), F.count(F.lit(1)).alias("events"))
    return one.unionByName(two)


# ---------------------------------------------------------------- preparation


@query(
    f"WITH {RAW} SELECT event_id, y AS \"YEAR\", m AS \"MONTH\", d AS \"DAY_OF_MONTH\", origin AS \"ORIGIN_AIRPORT_ID\", dest AS \"DEST_AIRPORT_ID\", crs AS \"CRS_DEP_TIME\", delay AS \"DEP_DELAY\", "
    "CAST(NULL AS VARCHAR) AS \"ARR_DELAY\", cancelled AS \"CANCELLED\", diverted AS \"DIVERTED\", carrier AS \"OP_UNIQUE_CARRIER\" FROM raw"
)
def scan_project(spark, sf_dir):
    """Columns by name, those that a file lacks as null."""
    raw = source.raw_records(spark, sf_dir)
    return raw.select("event_id", "YEAR", "MONTH", "DAY_OF_MONTH", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "CRS_DEP_TIME", "DEP_DELAY", F.lit(None).cast("string").alias("ARR_DELAY"), "CANCELLED", "DIVERTED", "OP_UNIQUE_CARRIER")


NAMES = ("YEAR", "MONTH", "DAY_OF_MONTH", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "CRS_DEP_TIME", "DEP_DELAY", "CANCELLED", "DIVERTED", "OP_UNIQUE_CARRIER")


def _csv_folder(spark, sf_dir) -> str:
    """The raw records as CSV files of two kinds, one with its columns in another order and one more of them."""
    at = jobs.shared(spark)
    raw = source.raw_records(spark, sf_dir)
    even, odd = raw.filter("event_id % 2 = 0").select(*NAMES), raw.filter("event_id % 2 = 1").select("event_id", *reversed(NAMES))
    for i, part in enumerate((even, odd)):
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/{i}")
    return at


def _counted(sql: str, columns: str) -> str:
    return f"{sql} SELECT {columns}, count(*) AS records FROM found GROUP BY ALL"


@query(_counted(
    f"WITH {RAW}, found AS (SELECT y, m, d, CASE WHEN carrier IS NULL THEN NULL ELSE event_type END AS carrier, nullif(delay, '') AS delay, cancelled FROM raw)",
    'y AS "YEAR", m AS "MONTH", d AS "DAY_OF_MONTH", carrier AS "CARRIER", delay AS "DEP_DELAY", cancelled AS "CANCELLED"',
))
def scan_csv(spark, sf_dir):
    """Raw records through CSV files and ``scan``; they have no number there, so equal ones are counted."""
    at = _csv_folder(spark, sf_dir)
    rows = source.scan(spark, f"{at}/0").unionByName(source.scan(spark, f"{at}/1"))
    return rows.groupBy("YEAR", "MONTH", "DAY_OF_MONTH", F.nullif(prepare.carrier(F.col("OP_UNIQUE_CARRIER")), F.lit("")).alias("CARRIER"), "DEP_DELAY", "CANCELLED").agg(F.count(F.lit(1)).alias("records"))


@query(_counted(
    f"""WITH {PREPARED}, found AS (SELECT epoch_us(coalesce(scheduled, month_start)) // 1000 AS event_time, CASE WHEN carrier IS NULL THEN '' ELSE event_type END AS airline, origin_airport_id, dest_airport_id, crs_dep_time,
    round(coalesce({double_sql('delay')}, 0.0), 6) AS dep_delay, 0.0::DOUBLE AS arr_delay, coalesce({double_sql('cancelled')}, 0.0) AS cancelled, coalesce({double_sql('diverted')}, 0.0) AS diverted FROM times)""",
    "event_time, airline, origin_airport_id, dest_airport_id, crs_dep_time, dep_delay, arr_delay, cancelled, diverted",
))
def prepared_csv(spark, sf_dir):
    """The same files scanned and prepared, missing numbers as 0."""
    at = _csv_folder(spark, sf_dir)
    events = source.prepared(source.scan(spark, f"{at}/0").unionByName(source.scan(spark, f"{at}/1")), "zero")
    names = ("event_time", "airline", "origin_airport_id", "dest_airport_id", "crs_dep_time", "dep_delay", "arr_delay", "cancelled", "diverted")
    return events.groupBy(*names).agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {RAW}, {INTS} SELECT event_id, year, month, day_of_month, origin_airport_id, dest_airport_id, crs_dep_time FROM ints")
def coerce_int(spark, sf_dir):
    return source.raw_records(spark, sf_dir).select("event_id", *[prepare.as_int(F.col(r)).alias(n) for r, n in RAW_INT.items()])


@query(f"WITH {RAW} SELECT event_id, round({double_sql('delay')}, 6) AS dep_delay FROM raw")
def coerce_double(spark, sf_dir):
    return source.raw_records(spark, sf_dir).select("event_id", prepare.as_double(F.col("DEP_DELAY")).alias("dep_delay"))


def _missing(name: str, policy: str, sql: str):
    def run(spark, sf_dir):
        return source.raw_records(spark, sf_dir).select("event_id", *[prepare.filled(prepare.as_double(F.col(r)), policy).alias(RAW_DOUBLE[r]) for r in ("DEP_DELAY", "CANCELLED", "DIVERTED")])

    run.__name__ = name
    query(f"WITH {RAW} SELECT event_id, " + ", ".join(f"round({sql % double_sql(a)}, 6) AS {b}" for a, b in (("delay", "dep_delay"), ("cancelled", "cancelled"), ("diverted", "diverted"))) + " FROM raw")(run)


_missing("missing_policy_null", "null", "%s")
_missing("missing_policy_zero", "zero", "coalesce(%s, 0.0)")


@query(f"WITH {RAW} SELECT event_id, CASE WHEN carrier IS NULL THEN '' ELSE event_type END AS airline FROM raw")
def trim_carrier(spark, sf_dir):
    return source.raw_records(spark, sf_dir).select("event_id", prepare.carrier(F.col("OP_UNIQUE_CARRIER")).alias("airline"))


def _typed(spark, sf_dir) -> DataFrame:
    return source.raw_records(spark, sf_dir).select("event_id", *[prepare.as_int(F.col(r)).alias(n) for r, n in RAW_INT.items()])


def _moment(make) -> Column:
    return make(F.col("year"), F.col("month"), F.col("day_of_month"), F.col("crs_dep_time"))


@query(f"WITH {RAW}, {INTS}, {PARTS} SELECT event_id, crs_dep_time, hour, minute FROM parts")
def hhmm_decode(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", "crs_dep_time", prepare.hour(F.col("crs_dep_time")).alias("hour"), prepare.minute(F.col("crs_dep_time")).alias("minute"))


@query(f"WITH {RAW}, {INTS}, {PARTS} SELECT event_id, mm AS month, dd AS day_of_month FROM parts")
def date_clamp(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", prepare.month(F.col("month")).alias("month"), prepare.day(F.col("day_of_month")).alias("day_of_month"))


@query(f"WITH {PREPARED} SELECT event_id, scheduled FROM times")
def build_event_time(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", _moment(prepare.scheduled).alias("scheduled"))


@query(f"WITH {PREPARED} SELECT event_id, coalesce(scheduled, month_start) AS moment, scheduled IS NULL AS fell_back FROM times")
def event_time_fallback(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", _moment(prepare.event_time).alias("moment"), _moment(prepare.scheduled).isNull().alias("fell_back"))


@query(f"WITH {PREPARED} SELECT event_id, (epoch_us(coalesce(scheduled, month_start)) // 1000) AS event_time FROM times")
def to_epoch_millis(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", prepare.epoch_millis(_moment(prepare.event_time)).alias("event_time"))


@query(f"WITH {PREPARED} SELECT event_id, (epoch_us(coalesce(scheduled, month_start)) // 1000) AS event_time, row_number() OVER (ORDER BY (epoch_us(coalesce(scheduled, month_start)) // 1000) NULLS FIRST, event_id) AS position FROM times")
def stable_sort(spark, sf_dir):
    rows = _typed(spark, sf_dir).select("event_id", prepare.epoch_millis(_moment(prepare.event_time)).alias("event_time"))
    return numbered(rows, stretch_of(rows, F.col("event_time"), F.col("event_id")), ["event_time", "event_id"], "position")


@query("SELECT min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, round((max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 86400000.0::DOUBLE, 6) AS span_days FROM events")
def event_range(spark, sf_dir):
    return source.span(source.table(spark, sf_dir, "events").select(prepare.epoch_millis(F.col("ts")).alias("event_time")))


@query(
    f"""WITH {PREPARED} SELECT event_id, (epoch_us(coalesce(scheduled, month_start)) // 1000) AS event_time, year, month, day_of_month, CASE WHEN carrier IS NULL THEN '' ELSE event_type END AS airline,
    origin_airport_id, dest_airport_id, crs_dep_time, round({double_sql('delay')}, 6) AS dep_delay, CAST(NULL AS DOUBLE) AS arr_delay, {double_sql('cancelled')} AS cancelled, {double_sql('diverted')} AS diverted FROM times"""
)
def project_rename(spark, sf_dir):
    raw = source.raw_records(spark, sf_dir)
    ids = raw.select("event_id", F.struct(*[c for c in raw.columns if c != "event_id"]).alias("r"))
    fields = [prepare.as_int(F.col(f"r.{r}")).alias(n) for r, n in RAW_INT.items()]
    fields += [prepare.as_double(F.col(f"r.{r}")).alias(n) for r, n in RAW_DOUBLE.items() if r in raw.columns]
    typed = ids.select("event_id", *fields, prepare.carrier(F.col("r.OP_UNIQUE_CARRIER")).alias("airline"), F.lit(None).cast("double").alias("arr_delay"))
    return typed.withColumn("event_time", prepare.epoch_millis(_moment(prepare.event_time)))


CSV_SQL = f"""WITH {FLIGHTS}, lines AS (SELECT event_id, CAST((epoch_us(rowtime) // 1000) AS VARCHAR) || ',' || airline || ',' || CAST(origin_airport_id AS VARCHAR) || ',' || CAST(dest_airport_id AS VARCHAR) || ','
    || coalesce(CAST(round(dep_delay, 2) AS VARCHAR), '') || ',' || coalesce(CAST(cancelled AS VARCHAR), '') || ',' || CAST(diverted AS VARCHAR) AS line FROM flights) """


def _lines(spark, sf_dir) -> DataFrame:
    rows = source.flights(spark, sf_dir)
    return rows.select("event_id", prepare.csv_line(prepare.epoch_millis(F.col("rowtime")), F.col("airline"), F.col("origin_airport_id"), F.col("dest_airport_id"), F.round("dep_delay", 2), F.col("cancelled"), F.col("diverted")).alias("line"))


@query(CSV_SQL + "SELECT * FROM lines")
def csv_encode(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"WITH {FLIGHTS} SELECT event_id, (epoch_us(rowtime) // 1000) AS event_time, airline, origin_airport_id, dest_airport_id, round(dep_delay, 2) AS dep_delay, cancelled, diverted FROM flights")
def csv_parse_project(spark, sf_dir):
    schema = "event_time BIGINT, airline STRING, origin_airport_id INT, dest_airport_id INT, dep_delay DOUBLE, cancelled DOUBLE, diverted DOUBLE"
    return _lines(spark, sf_dir).select("event_id", F.from_csv("line", schema).alias("e")).select("event_id", "e.*")


@query(
    f"""WITH {PREPARED} SELECT epoch_us(coalesce(scheduled, month_start)) // 1000 AS event_time, year, month, day_of_month, CASE WHEN carrier IS NULL THEN '' ELSE event_type END AS airline,
    origin_airport_id, dest_airport_id, crs_dep_time, round({double_sql('delay')}, 6) AS dep_delay, {double_sql('cancelled')} AS cancelled, {double_sql('diverted')} AS diverted FROM times WHERE year >= 1"""
)
def avro_roundtrip(spark, sf_dir):
    """Prepared events in their wire form and back; those without a time have none."""
    events = source.prepared(source.raw_records(spark, sf_dir))
    back = avro.decoded(avro.encoded(events, 7)).filter("event_time IS NOT NULL")
    return back.select("event_time", "year", "month", "day_of_month", "airline", "origin_airport_id", "dest_airport_id", "crs_dep_time", "dep_delay", "cancelled", "diverted")


# ---------------------------------------------------------------- replay


def delays_sql(d: replay.Disorder) -> str:
    u = lambda m: f"((((event_id % 2147483648) * {m} + {d.seed * 12345}) % 2147483648) / 2147483648.0::DOUBLE)"
    delay = "0.0" if d.delay <= 0 else f"{u(69069)} * {d.delay}" if d.distribution == "uniform" else f"least(-{d.mean_delay}::DOUBLE * ln(1.0::DOUBLE - {u(69069)}), {d.delay}::DOUBLE)"
    return f"""{FLIGHTS}, chosen AS (SELECT *, (epoch_us(rowtime) // 1000) AS event_ms, {u(1103515245)} < {d.probability} AS held, {delay} AS seconds FROM flights),
    scheduled AS (SELECT *, event_ms + delay_ms AS arrival_ms FROM (SELECT *, CASE WHEN held THEN CAST(floor(seconds * 1000) AS BIGINT) ELSE 0 END AS delay_ms FROM chosen))"""


WATCHED = "watched AS (SELECT *, max(event_ms) OVER (ORDER BY arrival_ms, NOT held, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_ms FROM scheduled)"


def late_sql(seconds: float) -> str:
    return f"judged AS (SELECT *, coalesce(highest_ms - {int(seconds * 1000)} >= (event_ms // 3600000 + 1) * 3600000, false) AS late FROM watched)"


@query(f"WITH {delays_sql(DISORDER)} SELECT event_id, event_ms, held, delay_ms, arrival_ms, round(arrival_ms / 57600.0::DOUBLE, 6) AS wall_ms FROM scheduled")
def replay_schedule(spark, sf_dir):
    return replay.schedule(source.flights(spark, sf_dir), DISORDER).select("event_id", "event_ms", "held", "delay_ms", "arrival_ms", "wall_ms")


@query(f"WITH {delays_sql(DISORDER)} SELECT event_id, held FROM scheduled")
def holdback_select(spark, sf_dir):
    return source.flights(spark, sf_dir).select("event_id", replay.held(DISORDER).alias("held"))


@query(f"WITH {delays_sql(DISORDER)} SELECT event_id, round(seconds, 6) AS delay_seconds FROM chosen")
def holdback_uniform(spark, sf_dir):
    return source.flights(spark, sf_dir).select("event_id", replay.delay_seconds(DISORDER).alias("delay_seconds"))


EXPONENTIAL = replay.Disorder(0.3, 120, "exponential", 40)


@query(f"WITH {delays_sql(EXPONENTIAL)} SELECT event_id, round(seconds, 6) AS delay_seconds FROM chosen")
def holdback_exponential(spark, sf_dir):
    return source.flights(spark, sf_dir).select("event_id", replay.delay_seconds(EXPONENTIAL).alias("delay_seconds"))


@query(f"WITH {delays_sql(DISORDER)} SELECT event_id, arrival_ms, row_number() OVER (ORDER BY arrival_ms, NOT held, event_id) AS position FROM scheduled")
def replay_order(spark, sf_dir):
    return replay.delivered(replay.schedule(source.flights(spark, sf_dir), DISORDER)).select("event_id", "arrival_ms", "position")


@query(f"WITH {delays_sql(DISORDER)}, {WATCHED} SELECT count(*) AS events, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE event_ms < highest_ms) AS out_of_order FROM watched")
def out_of_order_count(spark, sf_dir):
    return replay.out_of_order(replay.schedule(source.flights(spark, sf_dir), DISORDER))


@query(f"WITH {delays_sql(DISORDER)}, {WATCHED}, {late_sql(300)} SELECT airline, count(*) AS events, count(*) FILTER (WHERE late) AS late_events FROM judged WHERE airline IN {IN_LIST} GROUP BY airline")
def late_loss_sim(spark, sf_dir):
    return replay.loss(source.flights(spark, sf_dir), DISORDER, 300, EVENT_AIRLINES)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {delays_sql(e.disorder)}, {WATCHED}, {late_sql(e.watermark_seconds)} SELECT '{e.name}' AS experiment, count(*) AS events, count(*) FILTER (WHERE held) AS held_events, count(*) FILTER (WHERE late) AS late_events FROM judged WHERE airline IN {IN_LIST})"
        for e in experiments.EXPERIMENTS
    )
)
def experiment_completeness(spark, sf_dir):
    return experiments.completeness(source.flights(spark, sf_dir), airlines=EVENT_AIRLINES)


# ---------------------------------------------------------------- merging, sinks, dashboards


@query(Q1_SQL + "SELECT * FROM q1")
def merge_dedup(spark, sf_dir):
    rows = rounded(status(spark, sf_dir))
    return merge.distinct_rows(rows, rows, rows)


@query(Q1_SQL + "SELECT *, row_number() OVER (ORDER BY window_start, airline) AS position FROM q1")
def merge_q1(spark, sf_dir):
    rows = rounded(status(spark, sf_dir))
    return merge.merged_status(rows, rows)


@query(ranking_sql(SIX_HOURS) + "SELECT * RENAME (airport_rank AS rank), row_number() OVER (ORDER BY ts, airport_rank) AS position FROM q2")
def merge_q2(spark, sf_dir):
    rows = rounded(airport_ranking.ranking(source.flights(spark, sf_dir), SIX_HOURS, LEAST[SIX_HOURS]))
    return merge.merged_ranking(rows, rows)


@query(Q1_SQL + "SELECT *, row_number() OVER (ORDER BY window_start, airline) AS position FROM q1")
def merge_part_files(spark, sf_dir):
    """Two runs' part files in one folder, as CSV without a header, read back, each row once and in order."""
    at = jobs.shared(spark)
    for _ in range(2):
        sinks.texts(rounded(status(spark, sf_dir))).write.mode("append").csv(at)
    return merge.merged_status(merge.parts(spark, at, Q1))


@query(Q1_SQL + "SELECT * FROM q1")
def merged_csv(spark, sf_dir):
    """The merged rows as one CSV file with a header, read back by name."""
    at = f"{jobs.shared(spark)}/{merge.experiment_name('q1.csv', '05')}"
    merge.write_merged(merge.merged_status(rounded(status(spark, sf_dir))), at)
    return spark.read.schema(Q1).option("header", True).option("enforceSchema", False).option("timestampNTZFormat", merge.TIME).csv(at)


@query(Q1_SQL + "SELECT * FROM q1")
def upsert_latest(spark, sf_dir):
    """An early, partial run and a complete one: of each key the latter's row remains."""
    all_rows = source.flights(spark, sf_dir)
    early = airline_status.status(all_rows.filter("event_id % 2 = 0"), EVENT_AIRLINES).withColumn("version", F.lit(1))
    whole = airline_status.status(all_rows, EVENT_AIRLINES).withColumn("version", F.lit(2))
    return merge.latest(early.unionByName(whole), ["window_start", "airline"], "version").drop("version")


@query(Q1_SQL + "SELECT * FROM q1")
def json_roundtrip(spark, sf_dir):
    return sinks.from_json(sinks.as_json(status(spark, sf_dir)), Q1)


def _series(field: str):
    def run(spark, sf_dir):
        return dashboards.series(status(spark, sf_dir), field, *RANGE)

    run.__name__ = "dash_series_" + {"late_departure_rate": "late_rate"}.get(field, field)
    query(Q1_SQL + f"SELECT window_start AS time, airline AS metric, {field} AS value, row_number() OVER (ORDER BY window_start, airline) AS position FROM q1 WHERE window_start >= TIMESTAMP '{RANGE[0]}' AND window_start < TIMESTAMP '{RANGE[1]}'")(run)


for _field in dashboards.SERIES:
    _series(_field)

LONG_SQL = Q1_SQL + ", points AS (" + " UNION ALL ".join(
    f"SELECT window_start AS time, airline, '{f}' AS field, {f}::DOUBLE AS value FROM q1 WHERE {f} IS NOT NULL AND window_start >= TIMESTAMP '{RANGE[0]}' AND window_start < TIMESTAMP '{RANGE[1]}'" for f in dashboards.SERIES
) + ") "


@query(LONG_SQL + "SELECT *, row_number() OVER (ORDER BY time, airline, field) AS position FROM points")
def dash_series_long(spark, sf_dir):
    return dashboards.long(status(spark, sf_dir), *RANGE)


@query(LONG_SQL + "SELECT airline, field, arg_max(value, time) AS last_value, max(value) AS max_value, count(*) AS points FROM points GROUP BY ALL")
def dash_legend_stats(spark, sf_dir):
    return dashboards.legend(dashboards.long(status(spark, sf_dir), *RANGE))


# ---------------------------------------------------------------- streams


@query(Q1_SQL + "SELECT * FROM q1")
def stream_q1(spark, sf_dir):
    return jobs.replayed(source.flights(spark, sf_dir), lambda s: jobs.status(s, EVENT_AIRLINES))


@query(Q1_SQL + "SELECT * FROM q1")
def stream_q1_ds(spark, sf_dir):
    return jobs.replayed(source.flights(spark, sf_dir), lambda s: jobs.status_by_partials(s, EVENT_AIRLINES), format="csv")


@query(ranking_sql(HOUR) + "SELECT * FROM q2")
def stream_q2_1h(spark, sf_dir):
    return jobs.replayed(source.flights(spark, sf_dir), lambda s: jobs.ranking(s, HOUR, LEAST[HOUR]), format="csv")


@query(ranking_sql(SIX_HOURS) + "SELECT * FROM q2")
def stream_q2_6h(spark, sf_dir):
    return jobs.replayed(source.flights(spark, sf_dir), lambda s: jobs.ranking(s, SIX_HOURS, LEAST[SIX_HOURS]))


@query(ranking_sql(GLOBAL) + "SELECT * FROM q2")
def stream_q2_global(spark, sf_dir):
    return jobs.replayed(source.flights(spark, sf_dir), lambda s: jobs.ranking(s, GLOBAL, LEAST[GLOBAL]))
