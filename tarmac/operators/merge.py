"""Results of several runs or part files made into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.ordered import numbered

TIME = "yyyy-MM-dd HH:mm:ss"


def distinct_rows(*runs: DataFrame) -> DataFrame:
    """Equal rows once."""
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.distinct()


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """For each key the row of the greatest version; among equal versions the greatest row. An aggregate, not a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in key and c != version]
    best = rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("best"))
    return best.select(*[F.col(k) if k in key else F.col(f"best.{k}") for k in rows.columns])


def positioned(rows: DataFrame, stretch: Column, order: list[str], name: str = "position") -> DataFrame:
    return numbered(rows, stretch, order, name)


def merged_status(*runs: DataFrame) -> DataFrame:
    """Q1's rows of all runs, each once, with their position by window and airline."""
    return positioned(distinct_rows(*runs), F.floor(F.unix_seconds(F.col("window_start").cast("timestamp")) / 86400), ["window_start", "airline"])


def merged_ranking(*runs: DataFrame) -> DataFrame:
    """Q2's rows of all runs, each once, with their position by window and rank; the rank's column is named rank."""
    return positioned(distinct_rows(*runs).withColumnRenamed("airport_rank", "rank"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400), ["ts", "rank", "origin_airport_id"])


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def part_files(spark: SparkSession, folder: str, below: bool = False) -> list[str]:
    """The finished part files of a folder in order of name (and, with ``below``, of the folders in it): named part-*, and not in progress."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    found, every = [], fs.listFiles(at, below)
    while every.hasNext():
        path = every.next().getPath()
        if path.getName().startswith("part-") and ".inprogress" not in path.getName():
            found.append(path.toString())
    return sorted(found)


def parts(spark: SparkSession, folder: str, schema: T.StructType, below: bool = False) -> DataFrame:
    """The rows of a folder's part files, which have no header; none if it has no such file."""
    files = part_files(spark, folder, below)
    return spark.read.schema(schema).option("timestampNTZFormat", TIME).csv(files) if files else spark.createDataFrame([], schema)


def write_merged(rows: DataFrame, path: str, position: str = "position") -> None:
    """One CSV file with a header, in order of ``position``. Parts are sorted and written side by side; then the driver joins them, a buffer at a time."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != position]
    text = rows.withColumns({n: F.date_format(n, TIME) for n, t in rows.dtypes if t.startswith("timestamp")})
    text.orderBy(position).select(*names).write.mode("overwrite").option("escape", '"').csv(f"{path}.parts")
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray((",".join(names) + "\n").encode()))
        for part in part_files(spark, f"{path}.parts"):
            one = fs.open(_files(spark, part)[1])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(one, out, spark._jsc.hadoopConfiguration(), False)
            one.close()
    finally:
        out.close()
    fs.delete(_files(spark, f"{path}.parts")[1], True)


def experiment_name(path: str, experiment: str) -> str:
    """``path`` with the experiment behind its stem, once."""
    experiment = experiment.strip() or "base"
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    if not dot:
        stem, suffix = name, "csv"
    if not stem.endswith(f"_{experiment}"):
        stem += f"_{experiment}"
    return f"{folder}{slash}{stem}.{suffix}"
