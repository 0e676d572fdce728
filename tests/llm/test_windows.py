import hashlib
import random
import re

import numpy as np
import pytest

from tarmac.llm.windows import PRIME, Hasher, deduplicated_windows, op7_windows, rolled, times


def brute(docs, length):
    """docs: (key, text) in order -> (key, words, kept words)."""
    seen, out = set(), []
    for key, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_hashes_tell_words_apart():
    h = Hasher(2)
    a = h.word_hashes("a b ab é a b\x1cc".encode())
    assert len(a) == 6 and a[0] == a[4] and len(set(a.tolist())) == 5
    counts, first, hashes = h.windows([b"x y x y", b"", b"x", b"y x y"])
    assert counts.tolist() == [4, 0, 1, 3] and first.tolist() == [0, 1, 2, 5, 6]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]


@pytest.mark.parametrize("block_bytes", [400, 10**7])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    say = lambda n, k=40: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    common, other = say(9), say(30)
    rows = []
    for i in range(120):
        kind = rng.randrange(6)
        text = [None, "  \t\n", say(rng.randrange(12), 3), f"{say(5)} {common}  {say(4)}", f"{other}\n{say(3)} {other}", say(20, 2)][kind]
        rows.append((rng.choice([None, *range(1000)]) if i % 9 == 0 else 1000 + i * 7, text))
    rows += [(5000, other), (5000, other), (5000, "x " * 50), (6000, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS block", "3 AS n_words")
    got = deduplicated_windows(docs, 6, block_bytes=block_bytes).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = brute(rows, 6)
    say_row = lambda r: str(tuple(r))
    assert sorted(say_row((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got) == sorted(map(say_row, want))
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed for r in got)
    assert deduplicated_windows(docs.limit(0), 6).count() == 0


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(docs, 20)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_windows(spark, sf).collect()}
    assert got == want and any(m for _, m, _ in want.values())


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark):
    """Two Thue-Morse words of one length: every polynomial modulo 2^64 with an odd base takes them for one."""
    for bits in (10, 11, 12):
        a = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
        b = a.translate(str.maketrans("ab", "ba"))
        head = " ".join(f"w{i}" for i in range(19))
        docs = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"x {head} {a}")], "doc_id long, text string")
        assert {r.doc_id: (r.n_words, r.n_removed) for r in deduplicated_windows(docs, 20).collect()} == {1: (20, 0), 2: (20, 0), 3: (21, 20)}


@pytest.mark.parametrize("ids", ["string", "long", "none"])
def test_long_texts_and_any_ids(spark, ids):
    """Texts of more than 1 MiB, clustered ids, ids that are strings, and no ids at all."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(220_000))
    assert len(long) > 1 << 20
    texts = [long, long[400_000:] + " end", "a b c " + long[:1_100_000], "", None, *(" ".join(f"v{rng.randrange(3)}" for _ in range(30)) for _ in range(40))]
    keys = {"string": [f"doc-{i * 37 % 45:09d}" for i in range(len(texts))], "long": [10**15 + i if i % 2 else i for i in range(len(texts))], "none": [None] * len(texts)}[ids]
    kind = "long" if ids == "long" else "string"
    docs = spark.createDataFrame(list(zip(keys, texts)), f"doc_id {kind}, text string").repartition(3)
    rows = sorted(zip(keys, texts), key=lambda r: (r[0] or "", r[1] is not None, (r[1] or "").encode()) if kind == "string" else r[0])
    want = sorted(map(repr, brute(rows, 20)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in deduplicated_windows(docs, 20, block_bytes=300_000).collect()]
    assert sorted(map(repr, got)) == want


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(1)
    x = rng.integers(0, PRIME, 1000, np.uint64)
    x[:3] = 0, 1, PRIME - 1
    for c in (0, 1, 2**32, PRIME - 1, 123456789012345678):
        assert times(x, c).tolist() == [int(v) * c % PRIME for v in x]
    for n in (1, 2, 3, 7, 20):
        plain = [sum(int(v) * pow(5, n - 1 - i, PRIME) for i, v in enumerate(x[a : a + n])) % PRIME for a in range(len(x) - n + 1)]
        assert rolled(x, n, 5).tolist() == plain
    assert len(rolled(x[:3], 4, 5)) == 0
