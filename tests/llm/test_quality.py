import math
import string
import zlib

import numpy as np

from tarmac.llm.quality import OrdinalModel, features, fitted, graded, loss_and_slope, model_of, op1_quality, scored


def test_scores_by_hand():
    model = OrdinalModel(3, 10, np.zeros(1024), np.array([-1.0, 2.0]))
    found = features("alpha beta", 10)
    model.weights[found] = 0.5
    s = 0.5 * len(found)
    tails = [1 / (1 + math.exp(t - s)) for t in (-1.0, 2.0)]
    assert np.allclose(model.tails(np.array([model.score(found)])), [tails])


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grade = [], []
    for i in range(600):
        g = i % 3
        rows.append(np.unique(np.concatenate([rng.integers(100, 1000, 20), [g]])))
        grade.append(g)
    model = OrdinalModel.fit(rows, np.array(grade), bits=10)
    assert model.weights[0] < model.weights[1] < model.weights[2]
    assert model.thresholds[0] < model.thresholds[1]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", "a"), (2, None, "b"), (3, "", None), (None, "bad idiot", "c"), (1, "good text here", "a"), (4, "word " * 200_000, "d")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (None, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    model = fitted(docs, graded(labels))
    got = scored(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in got)
    assert all(isinstance(r.keep, bool) for r in got)
    none = fitted(docs, graded(labels.limit(0)))
    assert {r.quality_score for r in scored(docs, none).collect()} == {0.0}
    assert scored(docs.limit(0), model).count() == 0


def test_held_out(spark):
    """Rows that the fit has not seen."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), graded(spark.read.parquet(f"{d}/labels.parquet"))
    model = fitted(docs, labels.filter("doc_id % 3 > 0"))
    got = scored(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model).select("grade", "keep").collect()
    share = lambda g: np.mean([r.keep for r in got if r.grade == g])
    assert share(2) > 0.95 and share(1) < 0.2 and share(0) < 0.2


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op1_quality(spark, sf).collect()}
    model = model_of(spark, docs, sf)
    model.weights = model.weights.astype(np.float32)
    for d in docs.collect():
        tails = model.tails(np.array([model.score(features(d.text, model.bits))]))[0]
        assert math.isclose(got[d.doc_id].expected_grade, tails.sum(), rel_tol=1e-9)
        assert got[d.doc_id].keep == (tails[-1] >= 0.5)


def test_slope_is_that_of_the_plain_likelihood():
    """The likelihood written down for each row, and its differences, against the gradient that the fit follows."""
    rng = np.random.default_rng(3)
    grades, used, n = 4, 5, 30
    has = rng.random((n, used)) < 0.5
    row, column = np.nonzero(has)
    grade = rng.integers(0, grades, n)
    weight = rng.random(n)
    p = rng.normal(size=used + grades - 1) * 0.5

    def plain(p):
        cuts = [p[used]]
        for gap in p[used + 1 :]:
            cuts.append(cuts[-1] + math.exp(gap))
        total = 0.3 * sum(x * x for x in p[:used]) / 2 / math.sqrt(used)
        for i in range(n):
            s = sum(p[j] for j in range(used) if has[i, j])
            tail = [1.0, *(1 / (1 + math.exp(c - s)) for c in cuts), 0.0]
            total -= weight[i] * math.log(tail[grade[i]] - tail[grade[i] + 1])
        return total

    loss, slope = loss_and_slope(p, used, row, column, grade, grades, weight, 0.3)
    assert math.isclose(loss, plain(p), rel_tol=1e-9)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        assert math.isclose(slope[k], (plain(p + e) - plain(p - e)) / 2e-6, rel_tol=1e-5, abs_tol=1e-7)


def test_features_by_a_plain_count():
    def plain(text, bits):
        names = set()
        for w in text.lower().split():
            while w and w[0] in string.punctuation:
                w = w[1:]
            while w and w[-1] in string.punctuation:
                w = w[:-1]
            if w:
                names.add(w)
        runs, at = [], ""
        for c in text + " ":
            if not c.isspace() and not (c.isalnum() or c == "_"):
                at += c
            elif at:
                runs.append(at)
                at = ""
        words = text.split()
        for r in set(runs):
            names.add("\0" + r + str(len(bin(runs.count(r) * 64 // len(words))) - 2 if runs.count(r) * 64 // len(words) else 0))
        shout = sum(w.isupper() for w in words) * 64 // max(1, len(words))
        names.add("\0upper" + str(len(bin(shout)) - 2 if shout else 0))
        names.add("\0long" + str(len(bin(len(words))) - 2 if words else 0))
        return sorted({zlib.crc32(x.encode()) % (1 << bits) for x in names})

    for text in ("", "Hello, hello!! WORLD?!?!?! (x) ...", "!!!!! a", "a,b;c d'e \"f\" " * 9, "ÄÖ ß--- --- ----- x_y"):
        assert features(text, 20).tolist() == plain(text, 20)
    # a run counts as it is, however long
    assert features("a !!!!", 20).tolist() != features("a !!!!!", 20).tolist()


def test_one_grade_only(spark):
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(20)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 2) for i in range(20)], "doc_id long, grade int")
    model = fitted(docs, ratings)
    got = scored(docs, model).collect()
    assert not model.weights.any() and {r.quality_score for r in got} == {0.0} and all(r.keep for r in got)
    assert list(model.thresholds) == sorted(model.thresholds)
