import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm.suffixes import Runs, common_prefixes, deduplicated_substrings, op9_suffixes, settled, suffix_array


def parts(strings):
    text = np.frombuffer(b"".join(strings), np.uint8)
    return text, np.concatenate([np.arange(len(s), 0, -1) for s in strings] or [np.zeros(0, int)]).astype(np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("ab", min_size=1, max_size=40).map(str.encode), max_size=6))
def test_suffix_array_and_common_prefixes(strings):
    text, rest = parts(strings)
    sa = suffix_array(text, rest)
    suffix = [bytes(text[i : i + r]) for i, r in enumerate(rest)]
    want = sorted(range(len(text)), key=lambda i: (suffix[i], i))
    assert sa.tolist() == want
    lcp = common_prefixes(text, rest, sa).tolist()
    for k in range(1, len(want)):
        a, b = suffix[want[k - 1]], suffix[want[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("shard", [30, 10**6])
def test_settled(shard):
    rng = random.Random(0)
    for _ in range(30):
        strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 20))) for _ in range(12)})
        rng.shuffle(strings)
        order = np.array([rng.randrange(5) for _ in strings])
        flat, windows = settled(strings, order, 6, shard)
        assert windows.tolist() == [len(s) - 5 for s in strings]
        for s, o, bits in zip(strings, order, np.split(flat, np.cumsum(windows)[:-1])):
            assert bits.tolist() == [any(s[i : i + 6] in t and p < o for t, p in zip(strings, order)) for i in range(len(s) - 5)]


def test_runs_hold_every_window():
    texts = [b"", b"x" * 49, b"x" * 50, bytes(range(256)) * 3, b"ab" * 400, b"y" * 700_000]
    runs = Runs(texts, 50)
    for d, t in enumerate(texts):
        own = runs.doc == d
        covered = [i for a, n in zip(runs.at[own], runs.windows[own]) for i in range(a, a + n)]
        assert covered == list(range(max(0, len(t) - 49)))


def brute(docs, length):
    """docs: (key, bytes) in order; the key None is least."""
    rank = lambda k: -1 if k is None else k
    first = {}
    for k, t in docs:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, 1 << 60), rank(k))
    out = []
    for k, t in docs:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < rank(k):
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((k, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("block_bytes,shard", [(900, 200), (10**7, 10**6)])
def test_against_brute_force(spark, block_bytes, shard):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, other = say(60), say(200)
    rows = []
    for i in range(90):
        text = [None, "", say(rng.randrange(60)), say(9) + common + say(30), other[rng.randrange(80) : 100 + rng.randrange(90)] + say(5) + common, "z" * rng.randrange(80)][rng.randrange(6)]
        rows.append((rng.choice([None, rng.randrange(2000), 700]) if i % 4 == 0 else 1000 + i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS block", "3 AS kept")
    got = deduplicated_substrings(docs, 30, block_bytes=block_bytes, shard=shard).collect()
    want = brute([(k, (t or "").encode()) for k, t in rows], 30)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.intervals), bytes(r.kept))) for r in got) == sorted(map(str, want))
    assert all(sum(s.end - s.start for s in r.intervals) == r.n_removed for r in got)
    assert deduplicated_substrings(docs.limit(0), 30).count() == 0


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {k: (n, m, s, hashlib.sha256(t).hexdigest()) for k, n, m, s, t in brute(docs, 50)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffixes(spark, sf).collect()}
    assert got == want and any(m for _, m, _, _ in want.values())


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_keys_are_sent_window_by_window(spark, hot):
    """A common phrase between different words, in every block; and long runs of one byte."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = say(35)
    texts = [say(rng.randrange(20)) + phrase + say(rng.randrange(40)) + " " * rng.randrange(60) + phrase[5:] for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = deduplicated_substrings(docs, 25, block_bytes=700, hot=hot).collect()
    want = brute([(k, t.encode()) for k, t in enumerate(texts)], 25)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.intervals), bytes(r.kept))) for r in got) == sorted(map(str, want))


@pytest.mark.parametrize("ids", ["string", "clustered", "none"])
def test_any_ids(spark, ids):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    common = say(60)
    texts = [say(rng.randrange(80)) + (common if rng.random() < 0.5 else "") for _ in range(50)]
    keys = {"string": [f"p/{i * 37 % 50:05d}" for i in range(50)], "clustered": [10**15 + i if i % 3 else i for i in range(50)], "none": [None] * 50}[ids]
    docs = spark.createDataFrame(list(zip(keys, texts)), f"doc_id {'string' if ids != 'clustered' else 'long'}, text string")
    got = deduplicated_substrings(docs, 20, block_bytes=600).collect()
    place = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    want = [(n, m, s, t) for _, n, m, s, t in brute([(place.get(k), t.encode()) for k, t in zip(keys, texts)], 20)]
    assert sorted((r.n_bytes, r.n_removed, len(r.intervals), bytes(r.kept)) for r in got) == sorted(want)
    assert ids == "none" or any(w[1] for w in want)


def test_a_key_is_hot_by_its_runs_not_by_blocks():
    """A phrase once in each of very many blocks is little in a bucket; between different words many times in a block it counts again."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = say(60)
    once, again = Runs([(say(200) + phrase + say(200)).encode(), (phrase * 40).encode()], 50).asked()
    assert len(set(once.tolist())) == len(once) and len(again) == 0
    keys, again = Runs([(say(90) + phrase[:40] + say(90)).encode() for _ in range(200)], 50).asked()
    most = np.unique(again, return_counts=True)[1].max()
    assert len(set(keys.tolist())) == len(keys) and 100 // 8 <= most <= 400 // 8


@pytest.mark.parametrize("size", [10**6, 10**9, 10**10, 6 * 10**10])
def test_a_block_has_few_buckets_to_write_to(size):
    from tarmac.llm.suffixes import SHELF, layout

    shelves, together = layout(size, SHELF, 2048)
    assert shelves * SHELF >= size and -(-shelves // together) <= 2048 and together <= 64


@pytest.mark.parametrize("hot", [0, 20_000])
def test_buckets_of_several_shelves(spark, hot):
    rng = random.Random(18)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common = [say(90) for _ in range(12)]
    texts = [say(rng.randrange(60)) + rng.choice(common)[rng.randrange(20) :] + say(9) + rng.choice(common) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = deduplicated_substrings(docs, 25, block_bytes=1500, hot=hot, shelf=300, rows=3).collect()
    want = brute([(k, t.encode()) for k, t in enumerate(texts)], 25)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.intervals), bytes(r.kept))) for r in got) == sorted(map(str, want))
