import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.llm.common import range_block
from tarmac.llm.fingerprints import fingerprinted, op4_fingerprints


def edited(text, after):
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0


def held_against(rows, got, samples):
    """rows: (key, text) in order."""
    by = {r.doc_id: r for r in got}
    texts = [(t or "") for _, t in rows]
    prints, off = {}, []
    for i, (k, t) in enumerate(rows):
        after = texts[(i + 1) % len(rows)]
        want = edited(texts[i], after)
        r = by[k]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(want.encode()).hexdigest()), k
        assert prints.setdefault(tuple(sorted(texts[i].split())), r.fingerprint) == r.fingerprint
        same = lambda a, b: sum(a[j : j + 8] == b[j : j + 8] for j in range(0, len(a), 8)) / samples
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == same(r.fingerprint, by[rows[(i + 1) % len(rows)][0]].fingerprint)
        off += [r.near_edited - jaccard(texts[i], want), r.near_next - jaccard(texts[i], after)]
    return off


@pytest.mark.parametrize("block_bytes", [500, 10**7])
def test_defined_cases(spark, block_bytes):
    rng = random.Random(4)
    rows = [(None, "null id é𝄞 words"), *((i * 3, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40)))) for i in range(60)), (500, None), (501, ""), (502, " \t\n"), (503, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS key", "3 AS place")
    got = fingerprinted(docs, 16, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    held_against(rows, got, 16)
    assert fingerprinted(docs.limit(0), 16).count() == 0


def test_ties(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a"), (1, "a"), (2, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprinted(docs, 4).collect())
    say = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 1, say("a")), (1, 1, say("a")), (1, 3, say("b b")), (2, 1, say("c"))])
    one = fingerprinted(docs.filter("doc_id = 2"), 4).first()
    assert one.near_next == 1.0


def test_query_estimates_generalised_jaccard(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = op4_fingerprints(spark, sf).collect()
    off = held_against(rows, got, len(got[0].fingerprint) // 8)
    assert abs(sum(off) / len(off)) < 0.01
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.1


@pytest.mark.parametrize("ids", ["string", "clustered", "none"])
def test_any_ids(spark, ids):
    """Ids that are strings, that lie close together in places, and no ids at all: blocks stay small and neighbours right."""
    rng = random.Random(6)
    texts = [f"{i * 7919 % 101:03d} " + " ".join(f"w{rng.randrange(50)}" for _ in range(20)) for i in range(101)]
    keys = {"string": [f"https://host/page-{i * 37 % 101:07d}" for i in range(101)], "clustered": [10**15 + i if i % 3 else i * 10**9 for i in range(101)], "none": [None] * 101}[ids]
    docs = spark.createDataFrame(list(zip(keys, texts)), f"doc_id {'string' if ids != 'clustered' else 'long'}, text string").repartition(4)
    block, blocks = range_block(docs, "doc_id", "text", 600)
    sizes = [r.n for r in docs.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 1500 and blocks >= len(sizes)
    rows = sorted(zip(keys, texts), key=lambda r: (r[0] or 0 if ids == "clustered" else r[0] or "", r[1]))
    got = fingerprinted(docs, 4, block_bytes=600).collect()
    want = sorted(hashlib.sha256(edited(t, rows[(i + 1) % 101][1]).encode()).hexdigest() for i, (_, t) in enumerate(rows))
    assert sorted(r.edited_sha256 for r in got) == want
    if ids != "none":
        held_against(rows, got, 4)


def test_sampling_by_hand(spark):
    """Each draw worked out from its definition: gamma variates from the hashes, the least ln a wins."""
    words = {"a": 3, "b": 1, "c": 2}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = fingerprinted(docs, 8).first().fingerprint
    hashed = {w: r.h for w, r in zip(words, spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect())}
    for k in range(8):
        rows = spark.createDataFrame([(h, words[w]) for w, h in hashed.items()], "h long, n long").select("h", "n", F.xxhash64("h", F.lit(2 * k)).alias("x"), F.xxhash64("h", F.lit(2 * k + 1)).alias("y")).collect()
        best = None
        for r in rows:
            x, y = r.x % 2**64, r.y % 2**64
            u = [((x >> 43) + 0.5) / 2**21, ((x >> 22) % 2**21 + 0.5) / 2**21, ((x >> 1) % 2**21 + 0.5) / 2**21, ((y >> 43) + 0.5) / 2**21, ((y >> 22) % 2**21 + 0.5) / 2**21]
            gamma, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
            t = math.floor(math.log(r.n) / gamma + u[4])
            ln_a = math.log(c) - gamma * (t - u[4]) - gamma
            best = min(best, (ln_a, r.h, t)) if best else (ln_a, r.h, t)
        code = spark.createDataFrame([best[1:]], "h long, t long").select(F.xxhash64("h", "t", F.lit(k)).alias("c")).first().c % 2**32
        assert got[8 * k : 8 * k + 8] == f"{code:08x}"
