"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed: the distinct words it has, in lower case and without the punctuation around them, and for each kind of punctuation run how dense it is, in powers of two. All grades share one weight for each feature; ordered thresholds cut the score into grades: P(grade >= k) = sigmoid(score - threshold k). From it come the expected grade and the probability of the top grades, by which texts are selected.

Grades of the query: 0 for toxic texts, 1 for texts of low quality, 2 for good ones.

Fitting uses at most ``bound`` rated rows, those of least seeded hash, so the same rows whatever their order; their features are collected (a few MB) and fitted on the driver by full-batch Adam. Scoring is one pass over the texts without any shuffle; only the weights are broadcast, whose number is fixed.

Defined cases: a null or empty text has only the constant feature; rows without a rating, or with a null in it, are not fitted; ids that repeat are fitted by each of their texts; if no row is rated, or all have one grade, all scores are 0 and thresholds keep the grades' shares; an empty table gives an empty result; other columns are carried through unless named like a result column, which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import documents, small_batches

_MARKS = re.compile(r"[^\w\s]+")
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None, bits: int) -> np.ndarray:
    """The hashed features of a text, distinct and in order."""
    text = text or ""
    words = text.split()
    named = {w.strip(_STRIP) for w in text.lower().split()}
    named.discard("")
    dense: dict[str, int] = {}
    for run in _MARKS.findall(text):
        dense[run] = dense.get(run, 0) + 1
    named |= {f"\0{run}{(n * 64 // len(words)).bit_length()}" for run, n in dense.items()}
    upper = sum(map(str.isupper, words)) if words else 0
    named.add(f"\0upper{(upper * 64 // max(1, len(words))).bit_length()}")
    named.add(f"\0long{len(words).bit_length()}")
    return np.unique(np.fromiter((crc32(w.encode("utf-8", "replace")) for w in named), np.int64, len(named)) & ((1 << bits) - 1))


def loss_and_slope(p: np.ndarray, used: int, row: np.ndarray, column: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of the grades, and its gradient. ``p``: the weights of the ``used`` features, the first threshold, and the logarithms of the gaps to the next ones, so that thresholds stay in order. Row ``row[i]`` has feature ``column[i]``."""
    n = len(grade)
    w, gaps = p[:used], np.exp(p[used + 1 :])
    theta = p[used] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(row, w[column], n)
    at = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))
    # the likelihood of grade g is at[g] - at[g + 1], with at[0] = 1 and at[grades] = 0
    full = np.hstack([np.ones((n, 1)), at, np.zeros((n, 1))])
    slope = full * (1 - full)
    i = np.arange(n)
    likely = np.maximum(full[i, grade] - full[i, grade + 1], 1e-12)
    d_at = np.zeros((n, grades - 1))
    low, high = grade >= 1, grade < grades - 1
    d_at[i[low], grade[low] - 1] -= slope[i, grade][low] / likely[low]
    d_at[i[high], grade[high]] += slope[i, grade + 1][high] / likely[high]
    d_at *= weight[:, None]
    d_theta = -d_at.sum(0)
    d_gaps = np.cumsum(d_theta[::-1])[::-1][1:] * gaps
    loss = -(weight * np.log(likely)).sum() + ridge * (w * w).sum() / 2 / used**0.5
    return float(loss), np.concatenate([np.bincount(column, d_at.sum(1)[row], used) + ridge * w / used**0.5, [d_theta.sum()], d_gaps])


@dataclass
class OrdinalModel:
    grades: int = 3
    bits: int = 20
    weights: np.ndarray = field(default=None, repr=False)
    thresholds: np.ndarray = None

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -60, 60)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], grade: np.ndarray, grades: int = 3, bits: int = 20, ridge: float = 0.2, rounds: int = 100, rate: float = 0.1, least: int = 4) -> OrdinalModel:
        model = cls(grades, bits, np.zeros(1 << bits), np.zeros(grades - 1))
        share = np.array([(grade >= k).mean() if len(grade) else 0.5 for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
        cut = np.minimum.accumulate(np.log(share / (1 - share)) - 1e-6 * np.arange(grades - 1))
        model.thresholds = -cut
        if len(set(grade.tolist())) < 2:
            return model
        # a feature of fewer than ``least`` rows says nothing of others and keeps weight 0
        at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        common = np.bincount(at, minlength=1 << bits)[at] >= least
        row = row[common]
        used, column = np.unique(at[common], return_inverse=True)
        p = np.concatenate([np.zeros(len(used)), [-cut[0]], np.log(np.maximum(np.diff(-cut), 1e-3))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        # each grade counts alike in part, so that rare grades are heard
        weight = np.array([(len(grade) / grades / max(1, (grade == k).sum())) ** 0.5 for k in range(grades)])[grade]
        weight /= weight.sum()
        for t in range(1, rounds + 1):
            _, grad = loss_and_slope(p, len(used), row, column, grade, grades, weight, ridge)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights[used] = p[: len(used)]
        model.thresholds = p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])
        return model


def fitted(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", grades: int = 3, bits: int = 20, bound: int = 12_000, seed: int = 7, **how) -> OrdinalModel:
    """A model of ``ratings`` (key, grade 0 .. grades - 1) of texts in ``docs``, from at most ``bound`` rated rows."""
    small_batches(docs.sparkSession)
    chosen = ratings.select(F.col(key).alias("rated"), F.col(grade).cast("int").alias("rated_grade")).filter(F.col("rated").isNotNull() & F.col("rated_grade").between(0, grades - 1))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "rated"), "rated", "rated_grade").limit(bound)
    schema = "id long, grade int, found array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), bits) for t in batch.column(2)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "grade", "found"])

    # at most ``bound`` rows of (id, grade), so this broadcast has a fixed size
    rated = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("rated"))
    got = rated.select(F.xxhash64("id", "body").alias("id"), F.col("rated_grade").alias("grade"), "body").mapInArrow(run, schema).orderBy("id", "grade").limit(bound).toArrow()
    rows = [np.asarray(x.values.to_numpy(), dtype=np.int64) if x.values is not None else np.zeros(0, np.int64) for x in got.column("found").combine_chunks()] if got.num_rows else []
    return OrdinalModel.fit(rows, got.column("grade").to_numpy().astype(np.int64), grades, bits, **how)


def scored(docs: DataFrame, model: OrdinalModel, keep_at: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with quality_score, expected_grade, tail_probability (of the top grade) and keep (tail_probability >= keep_at)."""
    small_batches(docs.sparkSession)
    added = [("quality_score", T.DoubleType()), ("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("keep", T.BooleanType())]
    names = [c for c in docs.columns if c not in dict(added)]
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(n, t) for n, t in added]])
    where = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.grades, model.bits, model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        for batch in batches:
            score = np.array([model.score(features(t.as_py(), model.bits)) for t in batch.column(where)])
            tails = model.tails(score)
            new = [score, tails.sum(1), tails[:, -1], tails[:, -1] >= keep_at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def model_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    return fitted(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, the probability of the top grade, and whether it is kept."""
    docs = documents(spark, sf_dir)
    return scored(docs.select("doc_id", "text"), model_of(spark, docs, sf_dir)).drop("text")
