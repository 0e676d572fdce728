"""Where flights come from: raw CSV records, prepared tables, and the driver's ``events`` table read as flights."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import prepare
from tarmac.schema import FLIGHT, RAW, RAW_DOUBLE, RAW_INT, RAW_TEXT

#: Airlines of the ``events`` view that Q1 follows.
EVENT_AIRLINES = ("click", "view", "error", "purchase")


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The CSV files of a folder in order of name, or the file itself. Through Spark's file systems, so that any store will do."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(hadoop)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        return [path]
    found = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(".csv"))
    if not found:
        raise FileNotFoundError(f"no CSV files in {path}")
    return found


def header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The names in a CSV file's first line."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), "UTF-8"))
    try:
        first = lines.readLine() or ""
    finally:
        lines.close()
    return tuple(next(csv.reader([first.removeprefix("\ufeff")]), ()))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw records as text, known columns by name; files of other columns (such as lookups) give no rows. Records with too many fields are skipped, and those with too few have nulls. Files of one header are one read."""
    alike: dict[tuple[str, ...], list[str]] = {}
    for file in csv_files(spark, path):
        alike.setdefault(header(spark, file), []).append(file)
    parts = []
    for names, files in alike.items():
        if known := [n for n in names if n in RAW]:
            # one field more than the header has, which only records with too many fill
            schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
            rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", encoding="UTF-8").csv(files).filter(F.col(f"c{len(names)}").isNull())
            parts.append(projected(rows.select(*[F.col(f"c{names.index(n)}").alias(n) for n in dict.fromkeys(known)])))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in RAW))
    return reduce(DataFrame.unionByName, parts)


def projected(raw: DataFrame) -> DataFrame:
    """All raw columns in order; those that are missing are null."""
    return raw.select(*[F.col(c).cast("string").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW])


def prepared(raw: DataFrame, missing: str = "null") -> DataFrame:
    """Raw records as events."""
    ints = [prepare.as_int(F.col(r)).alias(n) for r, n in RAW_INT.items()]
    doubles = [prepare.filled(prepare.as_double(F.col(r)), missing).alias(n) for r, n in RAW_DOUBLE.items()]
    text = [prepare.carrier(F.col(r)).alias(n) for r, n in RAW_TEXT.items()]
    typed = projected(raw).select(*ints, *doubles, *text)
    moment = prepare.event_time(F.col("year"), F.col("month"), F.col("day_of_month"), F.col("crs_dep_time"))
    return typed.withColumn("event_time", prepare.epoch_millis(moment)).select(*FLIGHT.names)


def in_order(events: DataFrame, *ties: str) -> DataFrame:
    """Sorted by event time; ties by the columns named. A range exchange, no single task."""
    return events.orderBy("event_time", *ties)


def span(events: DataFrame) -> DataFrame:
    """One row: the first and last event time, and the days between."""
    ends = events.agg(F.min("event_time").alias("first_ms"), F.max("event_time").alias("last_ms"))
    return ends.withColumn("span_days", (F.col("last_ms") - F.col("first_ms")) / 86_400_000)


def write_prepared(events: DataFrame, path: str, format: str = "parquet", again: bool = False) -> None:
    """Does nothing if the output is there, unless ``again``."""
    events.write.mode("overwrite" if again else "ignore").format(format).options(**({"header": "true"} if format == "csv" else {})).save(path)


def read_prepared(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(FLIGHT).format(format).options(**({"header": "true"} if format == "csv" else {})).load(path)


def with_rowtime(events: DataFrame) -> DataFrame:
    return events.withColumn("rowtime", prepare.from_millis(F.col("event_time")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as flights; nulls and flags follow the event's number."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("rowtime"), F.col("event_type").alias("airline"), F.col("user_id").cast("int").alias("origin_airport_id"), (n % 97).cast("int").alias("dest_airport_id"),
        F.when(n % 13 != 0, F.col("value") - 10.0).alias("dep_delay"),
        F.when(n % 17 == 0, 1.0).when(n % 19 != 0, 0.0).alias("cancelled"),
        F.when(n % 23 == 0, 1.0).otherwise(0.0).alias("diverted"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw text records with the faults that such records have, beside event_id."""
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 29 == 0, None).when(n % 31 == 0, "x").otherwise("2025").alias("YEAR"),
        text(n % 15).alias("MONTH"), text(n % 33).alias("DAY_OF_MONTH"),
        F.when(n % 41 != 0, F.concat(F.lit("  "), "event_type", F.lit("\t "))).alias("OP_UNIQUE_CARRIER"),
        F.when(n % 43 == 0, "bad").when(n % 59 == 0, "NaN").when(n % 61 == 0, "1e12").otherwise(text(F.col("user_id"))).alias("ORIGIN_AIRPORT_ID"),
        F.when(n % 67 == 0, "inf").when(n % 71 == 0, "12f").otherwise(F.concat(text(n % 97), F.lit(".7"))).alias("DEST_AIRPORT_ID"),
        F.when(n % 47 != 0, F.when(n % 50 == 1, "2400").otherwise(text((n * 37) % 2401))).alias("CRS_DEP_TIME"),
        F.when(n % 13 == 0, "").when(n % 53 == 0, "n/a").when(n % 73 == 0, "NaN").when(n % 79 == 0, "1.0d").when(n % 83 == 0, " -1.5e1\t").otherwise(text(F.col("value"))).alias("DEP_DELAY"),
        F.when(n % 17 == 0, "1.00").when(n % 19 != 0, "0.00").alias("CANCELLED"),
        F.when(n % 23 == 0, "1.00").otherwise("0.00").alias("DIVERTED"),
    )
