import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm.bpe import Encoder, PerfectHash, Tables, coded, decoded, encoded, op3_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tables():
    return Tables.read(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "hello   world\n\n x", "é𝄞ß " * 50, "x" * 5000, "aAbB12 3's don't" + " " * 300, "<|endoftext|>", "​\u0000\t\r\n", "ab " * 900_000]


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 7, 1000):
        keys = [str(i).encode() for i in range(n)]
        assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_tables_rows_and_round_trip(spark, tables, theirs):
    rows = list(enumerate(TEXTS)) + [(None, "x y"), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text AS ids", "1 AS decoded")
    ids = encoded(docs, tables)
    got = ids.collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(**{"doc_id": i, "ids": theirs.encode_ordinary(t or "")})) for i, t in rows)
    back = decoded(ids, tables).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert encoded(docs.limit(0), tables).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_like_tiktoken(text):
    global OWN, THEIRS
    if "OWN" not in globals():
        OWN = Encoder(Tables.read(PATH, P.PATTERN))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    got = [i for _, ids, _ in OWN.encode([text]) for i in ids.tolist()]
    assert got == THEIRS.encode_ordinary(text)


def test_query(spark, sf, theirs):
    got = {r.doc_id: r for r in op3_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_lists_that_are_null_and_ids_that_are_not_in_the_vocabulary(spark, tables):
    rows = [(1, None), (2, []), (3, [None, 5, None]), (4, [-1, 5, len(tables.tokens), 2**31 - 1, 6]), (5, [5, 6])]
    got = {r.doc_id: bytes(r.decoded) for r in decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2), tables).collect()}
    five, six = tables.tokens[5], tables.tokens[6]
    assert got == {1: b"", 2: b"", 3: five, 4: five + six, 5: five + six}


def test_both_ways_at_once(spark, tables):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    one = encoded(docs, tables)
    want = {r.doc_id: (r.ids, bytes(r.decoded)) for r in decoded(one, tables, ("doc_id", "ids")).collect()}
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in coded(docs, tables).collect()} == want


def test_results_are_kept_in_two_generations(tables):
    own = Encoder(tables)
    own.MOST_KEPT = 8
    words = [f"zq{i % 13}xv{i % 5}".encode() for i in range(200)]
    fresh = Encoder(tables)
    assert [own.merged(w) for w in words] == [fresh.merged(w) for w in words]
    assert len(own.kept) <= 4 and len(own.older) <= 4
