"""What the operators of this folder share: the scratch folder, tables written to cut lineage, and ranges of ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folders of the tables that this process has written, for ``written_alone``.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. A folder of this machine only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tarmac-"))
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends here and a lost executor costs a reread only. ``narrow``: rows are few and small, so eight partitions share a file."""
    path = f"{scratch(df.sparkSession)}/tarmac/{name}-{uuid.uuid4().hex}"
    (df.coalesce(max(8, partitions(df.sparkSession) // 8)) if narrow else df).write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, as by ``written``; those that were written on the way to it are deleted."""
    before = len(_MADE)
    made = written(make(), name)
    for folder in _MADE[before:-1]:
        _delete(made.sparkSession, folder)
    del _MADE[before:]
    return made


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Batches of at most ``rows`` texts and about ``size`` bytes go to Python from now on in this session, unless it asks for less: what a worker and the buffers beside it hold follows the batch."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores behind that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def apart(c: Column, text: bool = False) -> Column:
    """The same value, a number unless ``text``, in a form that the planner does not see through. A join on it puts this side into an exchange of its own even where rows lie right already; only then can adaptive execution split a hot key of the other side."""
    return F.substring(c, 1, (1 << 31) - 1) if text else c.bitwiseXOR(F.lit(0).cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts; reads their lengths only."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def dealt(by: list[Column], blocks: int) -> Column:
    """A block from 0, by a hash of ``by``, whatever its types: blocks are of like size however the values are spread."""
    return F.pmod(F.xxhash64(*by), F.lit(blocks).cast("long"))


#: Quantiles that ranges are cut at, at most.
QUANTILES = 2_500


def _constants(values: list, kind: str) -> Column:
    """An array of constants as one literal; thousands of them would burden every step of planning."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _leading(text: Column, skip: int) -> Column:
    """The 7 bytes of a string behind the first ``skip``, as a number that follows the strings' order."""
    part = F.substring(F.encode(text, "UTF-8"), F.lit(skip + 1), F.lit(7))
    return F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("long")


def range_block(df: DataFrame, key: str, text: str, size: int) -> tuple[Column, int]:
    """An expression for the block of ``key``, and about how many blocks there are.

    Blocks follow the order of the key, then nulls first and by the beginning of their texts, and hold about ``size`` bytes of text: the keys are cut at up to ``QUANTILES`` approximate quantiles, and each stretch between two of them into equal widths. A string counts by the 7 bytes behind what all strings begin with. One or two aggregates over keys and lengths; equal keys share a block, but for nulls.
    """
    kind = df.schema[key].dataType
    k, skip = F.col(key), 0
    if isinstance(kind, T.StringType):
        ends = df.agg(F.min(k).alias("a"), F.max(k).alias("b")).first()
        a, b = ((ends[c] or "").encode() for c in ("a", "b"))
        skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        number = _leading(k, skip)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        number = F.unix_micros(k.cast("timestamp"))
    else:
        number = F.floor(k).cast("long")
    nameless = F.when(k.isNull(), _leading(F.coalesce(F.col(text), F.lit("")), 0))
    shares = _constants([i / QUANTILES for i in range(QUANTILES + 1)], "double")
    got = df.agg(
        F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.when(k.isNull(), F.octet_length(text))).alias("nameless"),
        F.percentile_approx(number, shares, 20_000).alias("q"), F.percentile_approx(nameless, shares, 20_000).alias("p"),
    ).first()
    some = got["nameless"] or 0
    named, n = _cut(number, got["q"], -(-((got["bytes"] or 0) - some) // size))
    unnamed, m = _cut(nameless, got["p"], -(-some // size))
    return F.when(k.isNull(), unnamed - m).otherwise(named).cast("long"), n + m


def _cut(number: Column, quantiles: list[int] | None, blocks: int) -> tuple[Column, int]:
    """The stretch of ``number``, from 0, and how many there are."""
    if not quantiles or blocks < 2:
        return F.lit(0).cast("long"), 1
    used = min(QUANTILES, blocks)
    cuts = sorted({quantiles[i * QUANTILES // used] for i in range(used + 1)})
    low, high = cuts[:-1] or cuts, cuts[1:] or [cuts[0] + 1]
    parts = max(1, -(-blocks // len(low)))
    # looked up in two steps: among every ``width``-th of the cuts, then among those from there on
    width = max(1, round(len(low) ** 0.5))
    at_most = lambda c: F.greatest(F.lit(1), F.size(F.filter(c, lambda b: b <= number)))
    before = (at_most(_constants(low[::width], "bigint")) - 1) * width
    segment = before + at_most(F.slice(_constants(low, "bigint"), before + 1, F.lit(width)))
    start, end = F.element_at(_constants(low, "bigint"), segment), F.element_at(_constants(high, "bigint"), segment)
    within = F.floor((number.cast("double") - start) * parts / F.greatest(F.lit(1.0), end.cast("double") - start))
    return ((segment - 1) * parts + F.least(F.greatest(within, F.lit(0)), F.lit(parts - 1))).cast("long"), len(low) * parts


def one_before(values: DataFrame, name: str, group: int = 4096) -> DataFrame:
    """of, before: each of the different ``name`` (long) and the next smaller one, the greatest for the least. In two levels, so that no task sees all."""
    coarse = values.select(F.col(name).alias("of"), F.floor(F.col(name) / group).alias("group"))
    every = Window.partitionBy(F.lit(0))
    last = coarse.groupBy("group").agg(F.max("of").alias("last")).select("group", F.coalesce(F.lag("last").over(every.orderBy("group")), F.max("last").over(every)).alias("last"))
    within = coarse.withColumn("near", F.lag("of").over(Window.partitionBy("group").orderBy("of")))
    return within.join(last, "group").select("of", F.coalesce("near", "last").alias("before"))


def sum_before(counts: DataFrame, by: list[str], order: str, value: str, name: str, group: int = 4096) -> DataFrame:
    """``counts`` with ``name``: the sum of ``value`` over the rows of smaller ``order`` (long, once each) among those with equal ``by``. In two levels, so that no task sees all of a large group."""
    coarse = counts.withColumn("coarse", F.floor(F.col(order) / group))
    whole = coarse.groupBy(*by, "coarse").agg(F.sum(value).alias("whole"))
    earlier = lambda *c: Window.partitionBy(*by, *c)
    up_to = Window.unboundedPreceding, -1
    whole = whole.withColumn("earlier", F.coalesce(F.sum("whole").over(earlier().orderBy("coarse").rowsBetween(*up_to)), F.lit(0))).drop("whole")
    inside = coarse.withColumn("inside", F.coalesce(F.sum(value).over(earlier("coarse").orderBy(order).rowsBetween(*up_to)), F.lit(0)))
    return inside.join(whole, [*by, "coarse"]).withColumn(name, F.col("inside") + F.col("earlier")).drop("coarse", "inside", "earlier")


def in_order(table: pa.Table, key: str, text: str) -> pa.Table:
    """Rows by key, then text; nulls first."""
    return table.take(pc.sort_indices(table, sort_keys=[(key, "ascending"), (text, "ascending")], null_placement="at_start"))
