import zlib
from collections import Counter

import pytest

from tarmac.llm.sharding import interleaved, op10_sharding


def held(rows, got, shards):
    """rows: (key, text, source)."""
    assert len(got) == len(rows)
    want = sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows), key=str)
    assert sorted(((r.key, r.size, r.text_crc32) for r in got), key=str) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and (not got or max(counts.values()) - min(counts.get(i, 0) for i in range(shards)) <= 1)
    for i, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == i) == list(range(n))
    # each shard has each stratum's share, to within a row or so
    strata = Counter(r.stratum_key for r in got)
    mix = Counter((r.shard, r.stratum_key) for r in got)
    for s, n in strata.items():
        for i in range(shards):
            assert abs(mix[i, s] - n * counts[i] / len(got)) < 2.5


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_shards_match_the_mixture(spark, range_rows):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 12}") for i in range(900)]
    rows += [(None, None, None), (None, "", None), (1, "text 1", "big"), (1, "text 1", "big"), (7, "é𝄞" * 20_000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS size", "3 AS slot", "4 AS n")
    got = interleaved(docs, 16, range_rows=range_rows).collect()
    held(rows, got, 16)
    assert sorted(map(str, got)) == sorted(map(str, interleaved(docs.repartition(5), 16, range_rows=range_rows * 3).collect()))
    few = docs.limit(5)
    held([(r.doc_id, r.text, r.source) for r in few.collect()], interleaved(few, 16).collect(), 16)
    assert interleaved(docs.limit(0)).count() == 0


def test_seed_shuffles(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source")
    a, b = ({r.key: r.shard for r in interleaved(docs, 16, seed=s).collect()} for s in (1, 2))
    assert a != b and sum(a[k] == k // 25 for k in a) < 80


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op10_sharding(spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.law for r in got.collect()} == {"rows"}
    held(docs, interleaved(spark.read.parquet(f"{sf}/documents.parquet")).collect(), 16)
