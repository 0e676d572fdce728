"""Streams of flights: files in order of arrival, or a Kafka topic where Spark has the connector."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import FLIGHT, VIEW
from tarmac.sources import avro

#: The end of a stream: an event so far ahead that every window closes. No query counts it.
END, END_AIRLINE = dt.datetime(2200, 1, 1), "__EOS__"


def end_of_stream(spark: SparkSession) -> DataFrame:
    row = (None, END, END_AIRLINE, 0, 0, None, 1.0, 1.0)
    return spark.createDataFrame([row], VIEW).withColumn("rowtime", F.lit(END).cast("timestamp_ntz").cast("timestamp"))


def write_chunks(flights: DataFrame, path: str, chunk: str, chunks: int, end: bool = True) -> None:
    """Flights as files of one stream in order of ``chunk`` (an expression, 0 up to ``chunks``, other rows are left out), then the end. All chunks are written by one job, side by side; a stream takes files in order of their times, so the times are set in order of the chunks."""
    spark = flights.sparkSession
    rows = flights.select(*[F.col(f.name).cast(f.dataType) for f in VIEW], F.expr(chunk).cast("int").alias("chunk")).filter(F.col("chunk").between(0, chunks - 1))
    files = []
    for batch in [rows.withColumn("file", F.col("chunk")).repartition(chunks, "chunk").sortWithinPartitions("chunk").drop("chunk")] + ([end_of_stream(spark).withColumn("file", F.lit(chunks))] if end else []):
        at = f"{path}/.new-{uuid.uuid4().hex}"
        batch.write.partitionBy("file").parquet(at)
        files.append(at)
    _publish(spark, files, path)


def _publish(spark: SparkSession, folders: list[str], path: str) -> None:
    """Moves the files of folders ``file=N`` into the stream's folder, later than what is there, a second apart for each N."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getModificationTime() for s in fs.listStatus(at) if s.isFile()]
    first = max([*there, int(time.time() * 1000)]) // 1000 * 1000 + 1000
    for folder in folders:
        for part in sorted((s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.isDirectory()), key=lambda p: int(p.getName().partition("=")[2])):
            when = first + 1000 * int(part.getName().partition("=")[2])
            for s in fs.listStatus(part):
                if not s.getPath().getName().startswith((".", "_")):
                    fs.setTimes(s.getPath(), when, -1)
                    # one task names its files alike in each folder
                    if not fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(at, f"{part.getName()}-{s.getPath().getName()}")):
                        raise OSError(f"can't move {s.getPath()}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def from_files(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(VIEW).option("maxFilesPerTrigger", files_at_once).parquet(path)


def of_events(events: DataFrame) -> DataFrame:
    """What the queries read of events on the wire. They have no number, so it is null."""
    return events.select(F.lit(None).cast("long").alias("event_id"), F.timestamp_millis("event_time").alias("rowtime"), *[F.col(f.name) for f in VIEW.fields[2:]])


def from_lines(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of files of CSV lines without a header, each an event's fields in order (as ``sources.ingest`` leaves them)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path)
    return of_events(lines.select(F.from_csv("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FLIGHT)).alias("e")).select("e.*"))


def from_kafka(spark: SparkSession, servers: str, topic: str, wire: str = "avro") -> DataFrame:
    """Events of a topic from the earliest offset, as ``avro`` (with the schema's number in front) or as ``json`` of a flight's columns; needs Spark's Kafka connector on the class path."""
    if wire not in ("avro", "json"):
        raise ValueError(f"no wire form {wire!r}")
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    if wire == "avro":
        return of_events(avro.decoded(raw))
    return raw.select(F.from_json(F.col("value").cast("string"), VIEW).alias("e")).select("e.*")
