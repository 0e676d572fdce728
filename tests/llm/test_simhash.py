import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarmac.llm.graph import components
from tarmac.llm.simhash import classes, deduplicated, fingerprints, links, op2_simhash


def plain(text, width=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t\n", "One", "One Two", "one two three", "É É É é", "a b c d e f g " * 9000, "x\x1cy z\x85w v", "nbsp joined word here"]


def test_fingerprints():
    assert [x % (1 << 64) for x in fingerprints(TEXTS, 3).tolist()] == [plain(t) for t in TEXTS]


@pytest.mark.parametrize("most", [30_000, 40])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = random.Random(1)
    found = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 120])):
            y = x
            for _ in range(rng.randrange(5)):
                y ^= 1 << rng.randrange(64)
            found.add(y if y < 1 << 63 else y - (1 << 64))
            if rng.random() < 0.2:
                x = y % (1 << 64)
    found = sorted(found)
    want = roots(found, [(a, b) for i, a in enumerate(found) for b in found[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    df = spark.createDataFrame([(x,) for x in found], "fingerprint long")
    got = links(df, most=most).collect()
    assert all(want[r.a] == want[r.b] for r in got)
    assert roots(found, [(r.a, r.b) for r in got]) == want
    assert len(got) < 4 * len(found) or most == 40


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)] + [(7, 7), (1, 0)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(3000))
    rows = [(5, None), (3, ""), (9, "same text over here again"), (8, "SAME text over here again"), (8, "SAME text over here again"), (None, " "), (None, "alone in the world"), (2, long), (4, long.replace("w500 ", "other ", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).withColumn("gone", F.lit(1))
    got = sorted(((str(r.doc_id), r.component_id) for r in classes(docs, 3).collect()), key=str)
    assert got == sorted([("5", 3), ("3", 3), ("None", 3), ("9", 8), ("8", 8), ("8", 8), ("None", None), ("2", 2), ("4", 2)], key=str)
    assert sorted(str(r.doc_id) for r in deduplicated(docs).collect()) == ["2", "3", "8", "8", "None", "None"]
    assert classes(docs.limit(0), 3).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = roots(docs, [(a, b) for a in docs for b in docs if b < a and (docs[a] ^ docs[b]).bit_count() <= 3])
    got = op2_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{f:016x}" for k, f in docs.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_a_long_chain(spark):
    """Far more rounds apart than a star; the numbers in a shuffled order."""
    order = list(range(5000))
    random.Random(4).shuffle(order)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert len(got) == 4999 and {r.root for r in got} == {0}


def test_a_hot_variant_is_passed_on_in_pieces(spark):
    """A group that spans many batches is given up as soon as it has too many, and its members come each once."""
    import pyarrow as pa

    from tarmac.llm.simhash import _edges

    f = np.arange(1000, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(n, v)), pa.array(np.zeros(n, np.int64)), pa.array(f[:n])], ["variant", "part", "fingerprint"]) for v, n in ((1, 3), (7, 100), (7, 100), (7, 100), (9, 2))]
    out = list(_edges(3, 150)(iter(batches)))
    hot = [(a, b) for o in out for a, b, h in zip(*(c.to_pylist() for c in o.columns)) if h]
    assert sorted(hot) == sorted((7, x) for _ in range(3) for x in range(100))
    assert max(o.num_rows for o in out) <= 200
