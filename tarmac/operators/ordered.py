"""Running values over a global order without one task that sees all rows.

Rows are cut into stretches that follow the order. Each stretch's own total is known from one aggregate; totals of the stretches before are joined on, and a window runs within a stretch only. A stretch is as large as its share of the rows: ``stretch_of`` cuts at quantiles of the time, and a time that very many rows have (or none) at quantiles of what orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of so many bits' stretches the totals are summed up in one task.
_GROUP_BITS = 12
#: Cuts at most, in all and within one time.
_PIECES, _WITHIN = 4_000, 1 << 20
_NONE = -(1 << 62)


def _constants(values: list, kind: str) -> Column:
    """An array of constants as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _at_most(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value)).cast("long")


def _rank(cuts: list[int], value: Column) -> Column:
    """How many of the cuts are at most ``value``; looked up among every ``width``-th of them, then among those from there on."""
    width = max(1, round(len(cuts) ** 0.5))
    before = F.greatest(_at_most(_constants(cuts[::width], "bigint"), value) - 1, F.lit(0)) * width
    return before + _at_most(F.slice(_constants(cuts, "bigint"), (before + 1).cast("int"), F.lit(width)), value)


def stretch_of(df: DataFrame, time: Column, tie: Column, pieces: int | None = None) -> Column:
    """Stretches of like size for rows in order of ``time`` (a number, null first), then ``tie`` (a number that tells rows of one time apart). One aggregate over the rows, and a second one where times are found that many rows have; at most some thousand cuts come to the driver, whatever the input."""
    n = min(_PIECES, pieces or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.coalesce(time.cast("long"), F.lit(_NONE)).alias("t"), tie.cast("long").alias("tie"))
    shares = _constants([i / n for i in range(n + 1)], "double")
    found = rows.agg(F.percentile_approx("t", shares, 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    many = sorted({a for a, b in zip(found, found[1:]) if a == b})
    t = F.coalesce(time.cast("long"), F.lit(_NONE))
    if len(cuts) < 2 and not many:
        return F.lit(0).cast("long")
    within = F.lit(_WITHIN - 1).cast("long")  # later times than the cut itself stand behind all that have it
    if many:
        most = max(2, min(n, 4 * n // len(many)))
        parts = rows.filter(F.array_contains(_constants(many, "bigint"), F.col("t"))).groupBy("t").agg(F.percentile_approx("tie", _constants([i / most for i in range(1, most)], "double"), 10 * most).alias("q"))
        ties = {r["t"]: sorted(set(r["q"] or [1 << 62])) for r in parts.collect()}
        lists = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, ties[v])) for v in many)), ";"), _rank(many, t).cast("int")), ",").cast("array<bigint>")
        within = F.when(F.array_contains(_constants(many, "bigint"), t), _at_most(lists, F.coalesce(tie.cast("long"), F.lit(_NONE)))).otherwise(within)
    return _rank(cuts, t) * _WITHIN + within


def _before(totals: DataFrame, combine, value: str) -> DataFrame:
    """of, before: ``combine`` of ``value`` over all smaller stretches, in two levels."""
    # a shift, not a division, which might be null: a test for that would work out each row's stretch once more, far below
    coarse = totals.withColumn("group", F.shiftright("of", _GROUP_BITS))
    groups = coarse.groupBy("group").agg(combine(value).alias("of_group"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", combine("of_group").over(earlier).alias("before_group"))
    inside = Window.partitionBy("group").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    return coarse.withColumn("inside", combine(value).over(inside)).join(groups, "group").select("of", "inside", "before_group")


def numbered(df: DataFrame, stretch: Column, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the position of each row (from 1) in the order of ``stretch`` (an integer), then ``order``."""
    rows = df.withColumn("_stretch", F.coalesce(stretch.cast("long"), F.lit(-1).cast("long")))
    totals = rows.groupBy(F.col("_stretch").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = _before(totals, F.sum, "n").select("of", (F.coalesce("inside", F.lit(0)) + F.coalesce("before_group", F.lit(0))).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(*order))
    return rows.join(before, F.col("_stretch") == F.col("of")).withColumn(name, F.col("_before") + place).drop("_stretch", "of", "_before")


def highest_before(df: DataFrame, stretch: Column, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows before it in that order; null in the first row."""
    rows = df.withColumn("_stretch", F.coalesce(stretch.cast("long"), F.lit(-1).cast("long")))
    totals = rows.groupBy(F.col("_stretch").alias("of")).agg(F.max(value).alias("n"))
    before = _before(totals, F.max, "n").select("of", F.greatest("inside", "before_group").alias("_before"))
    earlier = Window.partitionBy("_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, F.col("_stretch") == F.col("of")).withColumn(name, F.greatest(F.max(value).over(earlier), F.col("_before"))).drop("_stretch", "of", "_before")
