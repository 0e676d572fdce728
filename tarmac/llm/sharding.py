"""Sharding by proportional stratified interleaving.

Rows of each stratum (source) are put in a seeded random order. A row's fractional rank is (rank - 0.5) / rows of its stratum; rows sorted by it interleave all strata in proportion, and the sorted sequence is cut into shards of equal counts, so each shard has each stratum's share to within about one row.

No rank is taken in one task: an order is cut into ranges of the hash (or of the fraction), whose counts are summed up into offsets in two levels, and ``row_number`` runs within a range only. A source with most of the rows is thus dealt to as many tasks as its size asks for. The text is read once, by the scan; only narrow rows are shuffled.

Defined cases: a null text counts as empty; null sources form one stratum of their own; a null id is a value like others; rows that repeat id and text are kept, each with a slot; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import documents, sum_before, written


def interleaved(docs: DataFrame, shards: int = 16, seed: int = 42, key: str = "doc_id", text: str = "text", stratum: str = "source", range_rows: int = 1_000) -> DataFrame:
    """key, stratum_key, size, text_crc32, shard, slot for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")).alias("stratum_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    # 60 bits of a seeded hash: the random order of a stratum. MD5, so that SQL can say it too
    order = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in ("key", "text_crc32", "size")]).cast("binary"))
    base = written(base.withColumn("order", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")), "sharding-rows")
    total = base.count()
    ranges = max(1, -(-total // range_rows))

    cell = F.shiftright(F.shiftright("order", 29) * ranges, 31)
    base = base.withColumn("cell", cell)
    cells = base.groupBy("stratum_key", "cell").agg(F.count(F.lit(1)).alias("n"))
    strata = cells.groupBy("stratum_key").agg(F.sum("n").alias("in_stratum"))
    cells = sum_before(cells, ["stratum_key"], "cell", "n", "before").join(strata, "stratum_key")
    cells = cells.select(F.col("stratum_key").alias("of_stratum"), F.col("cell").alias("of_cell"), "before", "in_stratum")
    within = Window.partitionBy("stratum_key", "cell").orderBy("order", "key", "text_crc32", "size")
    ranked = (
        base.join(cells, (F.col("stratum_key") == F.col("of_stratum")) & (F.col("cell") == F.col("of_cell")))
        .withColumn("rank", F.col("before") + F.row_number().over(within))
        .withColumn("fraction", (F.col("rank") - 0.5) / F.col("in_stratum"))
        .withColumn("stretch", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)))
        .select("key", "stratum_key", "size", "text_crc32", "order", "fraction", "stretch")
    )
    ranked = written(ranked, "sharding-ranked")

    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    stretches = sum_before(stretches, [], "stretch", "n", "before").select(F.col("stretch").alias("of_stretch"), "before")
    within = Window.partitionBy("stretch").orderBy("fraction", "order", "stratum_key", "key", "text_crc32", "size")
    place = F.col("before") + F.row_number().over(within) - 1
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.join(stretches, F.col("stretch") == F.col("of_stretch"))
        .withColumn("place", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("place") - first)
        .select("key", "stratum_key", "size", "text_crc32", "shard", "slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 15 under the law ``rows``. This method's only groups are the sources, its strata; equal texts are dealt like any other rows."""
    return interleaved(documents(spark, sf_dir)).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
