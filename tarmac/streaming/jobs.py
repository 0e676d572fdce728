"""The continuous queries over a stream of flights."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import flags
from tarmac.functions.windows import HOUR, watermarked
from tarmac.operators import airline_status, airport_ranking
from tarmac.sources import streams
from tarmac.streaming import sinks

DELAY = 180


def status(stream: DataFrame, airlines: tuple[str, ...] = flags.AIRLINES, delay: int = DELAY, size: str = HOUR) -> DataFrame:
    return airline_status.status(watermarked(stream, delay), airlines, size)


def status_by_partials(stream: DataFrame, airlines: tuple[str, ...] = flags.AIRLINES, delay: int = DELAY, size: str = HOUR) -> DataFrame:
    """The same by mergeable counts, with the watermark behind the filter, so that other airlines' flights don't move it. The stream's end passes the filter, or the last window would stay open, and is not counted."""
    chosen = watermarked(stream.filter(flags.of_airlines((*airlines, streams.END_AIRLINE))), delay)
    return airline_status.finished(airline_status.partials(chosen, airlines, size))


def ranking(stream: DataFrame, size: str, least: int = airport_ranking.LEAST, delay: int = DELAY) -> DataFrame:
    return airport_ranking.ranking_stream(watermarked(stream, delay), size, least)


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/tarmac/stream-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def produced(flights: DataFrame, path: str, chunk: str, chunks: int, again: bool = False) -> bool:
    """Writes a stream's files unless there are some already (as one would not produce into a topic that has events); whether it did."""
    at = flights.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(flights.sparkSession._jsc.hadoopConfiguration())
    if not again and fs.exists(at) and any(s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at)):
        return False
    streams.write_chunks(flights, path, chunk, chunks)
    return True


def replayed(flights: DataFrame, query, chunks: int = 4, format: str = "parquet") -> DataFrame:
    """``query`` of the flights as a stream: ``chunks`` files in order of time, then the end of the stream; the result once all is read."""
    spark, at = flights.sparkSession, shared(flights.sparkSession)
    ends = flights.agg(F.min("rowtime").cast("timestamp").cast("long").alias("a"), F.max("rowtime").cast("timestamp").cast("long").alias("b")).first()
    width = max(1, (ends["b"] - ends["a"]) // chunks + 1)
    streams.write_chunks(flights, f"{at}/in", f"floor((cast(cast(rowtime as timestamp) as long) - {ends['a']}) / {width})", chunks)
    stream = query(streams.from_files(spark, f"{at}/in"))
    sinks.to_files(stream, f"{at}/out", f"{at}/checkpoint", format).awaitTermination()
    removed(spark, f"{at}/in", f"{at}/checkpoint")
    return spark.read.schema(sinks.plain(stream).schema).option("timestampNTZFormat", sinks.TIME).format(format).load(f"{at}/out")
