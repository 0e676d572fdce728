"""Where results of streams go. Every sink takes a batch once: files by the stream's checkpoint, keyed tables by their key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tarmac.functions.prepare import csv_line
from tarmac.operators.merge import latest

TIME = "yyyy-MM-dd HH:mm:ss"


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, in ``value``; times as text."""
    return rows.select(F.to_json(F.struct("*"), {"timestampNTZFormat": TIME, "timestampFormat": TIME, "ignoreNullFields": "false"}).alias("value"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("value", schema, {"timestampNTZFormat": TIME, "timestampFormat": TIME}).alias("e")).select("e.*")


def plain(rows: DataFrame) -> DataFrame:
    """Times without a zone, as results have them."""
    return rows.select(*[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in rows.dtypes])


def texts(rows: DataFrame) -> DataFrame:
    """Times as text, as files of text have them."""
    rows = plain(rows)
    return rows.select(*[F.date_format(n, TIME).alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in rows.dtypes])


def started(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Runs until the input ends or, with ``every`` (such as "200 milliseconds"), on and on at that pace."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_files(stream: DataFrame, path: str, checkpoint: str, format: str = "csv", every: str | None = None) -> StreamingQuery:
    """Appends each closed window once, without a header."""
    rows = texts(stream) if format == "csv" else plain(stream)
    writer = rows.writeStream.format(format).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return started(writer, every)


def to_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each closed window as one JSON object; needs Spark's Kafka connector on the class path."""
    writer = as_json(plain(stream)).writeStream.format("kafka").outputMode("append").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    return started(writer, every)


def kafka(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """The same as one of the writers of ``fan_out``."""

    def write(batch: DataFrame, number: int) -> None:
        as_json(plain(batch)).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def post(url: str, lines: int = 100, tries: int = 3, wait: float = 1.0, timeout: float = 30.0) -> Callable[[DataFrame, int], None]:
    """Posts each batch's rows as CSV lines without a header, ``lines`` at a time, from the executors. What is refused or fails is sent again, after ``wait`` seconds and then twice that; after ``tries`` the batch fails. A batch that comes again is sent again."""
    if lines <= 0 or tries <= 0:
        raise ValueError("lines and tries must be above 0")

    def send(body: bytes) -> None:
        for n in range(1, tries + 1):
            try:
                with urlopen(Request(url, body, {"Content-Type": "text/csv"}), timeout=timeout):
                    return
            except OSError:
                if n == tries:
                    raise
                time.sleep(wait * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), lines):
                send("".join(f"{t}\n" for t in texts[at : at + lines]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64())], ["sent"])

    def write(batch: DataFrame, number: int) -> None:
        rows = texts(batch)
        rows.select(csv_line(*[F.col(c) for c in rows.columns]).alias("line")).mapInArrow(run, "sent long").agg(F.sum("sent")).collect()

    return write


def keyed(path: str, key: list[str], fold: int = 100) -> Callable[[DataFrame, int], None]:
    """A table under ``path`` with one row for each key: each batch is a folder of its own, written over if the batch comes again, so a restart changes nothing. Every ``fold`` batches, those before are folded into one with the last row of each key. ``read_keyed`` gives the last row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        plain(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")
        if number and number % fold == 0:
            before = [f for f in _folders(spark, path) if f.rpartition("/")[2] < f"batch-{number:012d}"]
            if len(before) > 1:
                # the folded table takes the place of the newest; readers see rows twice for a moment, never not at all
                latest(spark.read.parquet(*before), key, "batch").write.mode("overwrite").parquet(f"{path}/batch-{number - 1:012d}.folded")
                for f in before:
                    _files(spark, f)[0].delete(_files(spark, f)[1], True)

    return write


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch-"))


def read_keyed(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/batch-*")
    return latest(rows, key, "batch").drop("batch")


def merge_sql(table: str, columns: list[str], key: list[str], form: str = "conflict") -> str:
    """The statement that puts the rows of ``table``_staging into ``table`` by key. ``form``: "conflict" (PostgreSQL, SQLite) or "merge" (standard SQL, for databases that have MERGE)."""
    rest, own = [c for c in columns if c not in key], f"{table}_staging"
    names = ", ".join(columns)
    if form == "conflict":
        update = f"DO UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in rest)}" if rest else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {own} WHERE true ON CONFLICT ({', '.join(key)}) {update}"
    if form != "merge":
        raise ValueError(f"no form {form!r}")
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = {own}.{c}' for c in rest)}" if rest else ""
    same = " AND ".join(f"{table}.{k} = {own}.{k}" for k in key)
    return f"MERGE INTO {table} USING {own} ON {same}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f'{own}.{c}' for c in columns)})"


def jdbc(url: str, table: str, key: list[str], properties: dict[str, str], form: str = "conflict") -> Callable[[DataFrame, int], None]:
    """Upserts each batch into a table of a database that has it: executors fill ``table``_staging anew, then one statement merges its rows by key. A batch that comes again, or a run that broke off in between, changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = plain(batch)
        rows.write.option("truncate", True).jdbc(url, f"{table}_staging", "overwrite", properties)
        jvm = batch.sparkSession.sparkContext._jvm
        own = jvm.java.util.Properties()
        for k, v in properties.items():
            own.setProperty(k, v)
        db = jvm.java.sql.DriverManager.getConnection(url, own)
        try:
            db.createStatement().execute(merge_sql(table, rows.columns, key, form))
        finally:
            db.close()

    return write


def fan_out(stream: DataFrame, checkpoint: str, *writers: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Every writer gets the same rows, computed once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, number)
        finally:
            batch.unpersist()

    return started(stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write), every)


def rates(log: Callable[[str], None]) -> StreamingQueryListener:
    """A listener that logs, after each batch, the rows so far, the seconds since the start and the rows a second; for ``spark.streams.addListener``."""

    class Rates(StreamingQueryListener):
        def __init__(self):
            self.rows: dict[str, tuple[float, int]] = {}

        def onQueryStarted(self, event) -> None:
            self.rows[str(event.runId)] = (time.monotonic(), 0)

        def onQueryProgress(self, event) -> None:
            run = str(event.progress.runId)
            began, rows = self.rows.get(run, (time.monotonic(), 0))
            rows += event.progress.numInputRows
            self.rows[run] = (began, rows)
            elapsed = time.monotonic() - began
            log(f"batch={event.progress.batchId} rows={rows} elapsed={elapsed:.1f}s throughput={rows / elapsed if elapsed > 0 else 0.0:.0f} rows/s")

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            self.rows.pop(str(event.runId), None)

    return Rates()
