import re
import sys

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tarmac.llm import bpe, quality
from tarmac.llm.decontaminate import Matcher, common_form
from tests.llm.test_decontaminate import least_distance
from tests.llm.test_secrets import brute
from tests.llm.test_simhash import plain, roots


def test_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.model_of(spark, docs, sf)
    model.weights = model.weights.astype(np.float32)
    kept = {k: r.text for k, r in rows.items() if model.tails(np.array([model.score(quality.features(r.text, model.bits))]))[0, -1] >= 0.5}
    prints = {k: plain(t, 3) for k, t in kept.items()}
    root = roots(kept, [(a, b) for a in kept for b in kept if b < a and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = {k: t for k, t in kept.items() if root[k] == k}
    items = [f for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(f := common_form(r.text)) >= 32]
    kept = {k: t for k, t in kept.items() if all(f[:40] not in (c := common_form(t)) or least_distance(f, c) > len(f) // 16 for f in items)}
    assert len(kept) > 0.5 * len(rows)
    tokens = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = {}
    for k, t in kept.items():
        out, at = "", 0
        for s, _, e in brute(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[k] = theirs.encode_ordinary(out + t[at:])
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_bear_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 100_000, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).schema == rows.schema
            stage(spark, rows, sf).collect()
        assert len(corpus_pipeline.encode(spark, rows, sf).collect()) == rows.count()


def test_against_plain_versions_by_similarity(spark, sf):
    """All stages; near-duplicates by the Jaccard similarity of five-word shingles, 0.8 or more, of all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.model_of(spark, docs, sf)
    model.weights = model.weights.astype(np.float32)
    kept = {k: r.text for k, r in rows.items() if model.tails(np.array([model.score(quality.features(r.text, model.bits))]))[0, -1] >= 0.5}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: shingles(t) for k, t in kept.items()}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = roots(kept, [(a, b) for a in kept for b in kept if b < a and alike(sets[a], sets[b])])
    assert any(sets[k] != sets[root[k]] for k in kept)
    kept = {k: t for k, t in kept.items() if root[k] == k}
    items = [(n, f, len(f) // 16 if len(f) >= 32 else 0) for n, r in enumerate(spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if (f := common_form(r.text))]
    matcher = Matcher(items, 32)
    kept = {k: t for k, t in kept.items() if not matcher.found(t)}
    assert len(kept) > 0.5 * len(rows)
    tokens = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = {}
    for k, t in kept.items():
        out, at = "", 0
        for s, _, e in brute(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[k] = theirs.encode_ordinary(out + t[at:])
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_short_items_go(spark):
    """A benchmark item of ten characters counts in the pipeline's stage too."""
    from tarmac.llm.decontaminate import uncontaminated

    docs = spark.createDataFrame([(1, "so, who is Ada? they asked"), (2, "who is Adam? they asked")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Who is Ada?")], "item_id long, text string")
    assert [r.doc_id for r in uncontaminated(docs, items).collect()] == [2]


def test_tables_on_the_way_are_deleted(spark, sf):
    """One table is left: the result's."""
    import os

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/tarmac"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, sf)
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["pipeline-5"]
