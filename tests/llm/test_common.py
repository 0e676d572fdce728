import os
import random

from pyspark.sql import functions as F

from tarmac.llm.common import apart, dealt, fresh, one_before, range_block, small_batches, sum_before, total_bytes, written, written_alone


def test_one_before_goes_around(spark):
    values = sorted(random.Random(1).sample(range(-500, 500), 60))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for group in (3, 4096):
        assert {r.of: r.before for r in one_before(df, "v", group).collect()} == {v: values[i - 1] for i, v in enumerate(values)}
    assert one_before(df.limit(0), "v").count() == 0
    assert [tuple(r) for r in one_before(df.filter(F.col("v") == values[0]), "v").collect()] == [(values[0], values[0])]


def test_sums_before(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(9)) for k in ("a", "b") for i in rng.sample(range(200), 50)]
    df = spark.createDataFrame(rows, "k string, i long, n long")
    for group in (7, 4096):
        got = {(r.k, r.i): r.s for r in sum_before(df, ["k"], "i", "n", "s", group).collect()}
        assert got == {(k, i): sum(n for q, j, n in rows if q == k and j < i) for k, i, _ in rows}
        got = {r.i: r.s for r in sum_before(df.filter("k = 'a'"), [], "i", "n", "s", group).collect()}
        assert got == {i: sum(n for q, j, n in rows if q == "a" and j < i) for k, i, _ in rows if k == "a"}


def test_ranges_follow_the_order(spark):
    """Of numbers and of texts, nulls first; small tables and empty ones are one block."""
    rng = random.Random(3)
    keys = [rng.choice([rng.randrange(100), 10**6 + rng.randrange(50), -(10**12)]) for _ in range(300)] + [None] * 40
    for kind, make in (("long", int), ("string", lambda k: f"x/0000{k % 10**7:07d}"), ("date", None)):
        if make is None:
            df = spark.createDataFrame([(k, f"t{i:04d}" * 5) for i, k in enumerate(keys)], "n long, text string").selectExpr("date_add(date'2000-01-01', cast(n % 10000 as int)) AS doc_id", "text")
        else:
            df = spark.createDataFrame([(None if k is None else make(k), f"t{i:04d}" * 5) for i, k in enumerate(keys)], f"doc_id {kind}, text string")
        block, _ = range_block(df, "doc_id", "text", 200)
        rows = [((r.doc_id is not None, r.doc_id if r.doc_id is not None else 0), r.text, r.b) for r in df.withColumn("b", block).collect()]
        rows.sort(key=lambda r: (r[0][0], r[0][1] if r[0][0] else r[1]))
        blocks = [b for _, _, b in rows]
        assert blocks == sorted(blocks) and len(set(blocks)) > 10
        assert range_block(df.limit(0), "doc_id", "text", 200)[1] >= 1
    assert total_bytes(df, "text") == 340 * 25 and total_bytes(df.limit(0), "text") == 0


def test_hashed_blocks_are_of_like_size(spark):
    df = spark.range(10_000).select((F.col("id") * 1_000_000).cast("string").alias("k"))
    sizes = [r["count"] for r in df.groupBy(dealt([F.col("k")], 20).alias("b")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.3 * 500


def test_tables_and_settings(spark):
    made = written_alone(lambda: written(spark.range(5).toDF("a"), "on-the-way").select((F.col("a") + 1).alias("b")), "result")
    assert sorted(r.b for r in made.collect()) == [1, 2, 3, 4, 5]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/tarmac"
    assert not [x for x in os.listdir(folder) if x.startswith("on-the-way")] and [x for x in os.listdir(folder) if x.startswith("result")]
    assert fresh(spark.range(1).selectExpr("id AS A", "id AS a_"), "a") == "a__"
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1m")
        small_batches(spark)
        assert spark.conf.get(name) == "1m"
        spark.conf.set(name, "512m")
        small_batches(spark)
        assert int(spark.conf.get(name)) == 8 << 20
    finally:
        spark.conf.set(name, before)


def test_a_side_apart_has_its_own_exchange(spark):
    """Else adaptive execution can't split a hot key."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for text, kind in ((False, "long"), (True, "string")):
            rows = spark.range(100).select((F.col("id") % 7).cast(kind).alias("k"), "id").repartition(3)
            least = rows.groupBy("k").agg(F.min("id").alias("least")).select(apart(F.col("k"), text).alias("of"), "least")
            joined = rows.join(least, F.col("k") == F.col("of"))
            assert "Exchange hashpartitioning(of" in joined._jdf.queryExecution().executedPlan().toString()
            assert all(r.k == r.of and r.least == int(r.k) for r in joined.collect())
    finally:
        spark.conf.set(name, before)
