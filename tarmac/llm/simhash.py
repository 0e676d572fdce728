"""SimHash near-duplicates over an index of deletion variants.

A fingerprint has 64 bits, each the majority over the XXH64 hashes of a text's word shingles. Two fingerprints link at ``radius`` = 3 or fewer differing bits. Cut into two halves, a linked pair has a half that differs in one bit at most; so every half is indexed under its 32 variants with one bit as a wildcard, and linked fingerprints meet under an equal variant. What meets is verified by its distance.

Only different fingerprints are indexed, each once however many texts have it. Under a variant, links are not emitted pair by pair: they are united at once and leave one edge for each member. A pair that meets under several variants counts under the first of them only. A variant with more than ``most`` members is cut into chunks, and each pair of chunks is verified in a task of its own. Components of the edges then give the classes.

Defined cases: a null, empty or blank text has fingerprint 0 and links like any other; rows that repeat are each returned; a null id takes part, but the least id of a component is taken over others, and is null if there are none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tarmac.llm.common import documents, fresh, small_batches, written
from tarmac.llm.graph import components, least_of_class

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
SLICE = 60_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """The fingerprint of each text, as signed 64 bits."""
    ones, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def count() -> None:
        nonlocal held
        if parts:
            bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *map(len, parts[:-1])])
            np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        rows.clear()
        parts.clear()
        held = 0

    for i, text in enumerate(texts):
        h = shingle_hashes(text, width)
        counts[i] = len(h)
        for at in range(0, len(h), SLICE):
            rows.append(i)
            parts.append(h[at : at + SLICE])
            held += len(parts[-1])
            if held >= SLICE:
                count()
    count()
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)


def fingerprinted(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [key, "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fingerprint", T.LongType())]))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            f = batch.column(0).slice(at, 4096).to_numpy()
            u = f.view(np.uint64)
            keys = []
            for half in range(2):
                own = (u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                keys += [own & np.uint64(0xFFFFFFFF ^ (1 << bit)) | np.uint64((half * 32 + bit) << 32) for bit in range(32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.zeros(64 * len(f), np.int64)), pa.array(np.tile(f, 64))], ["variant", "part", "fingerprint"])


class _Union:
    """Classes of 0..n-1, each named by its least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]


def _linked(a: np.ndarray, b: np.ndarray, variant: np.ndarray | int, radius: int) -> np.ndarray:
    """Whether a and b link, and ``variant`` is the first under which they meet."""
    x = a ^ b
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    first_half = np.bitwise_count(low) <= 1
    other = np.where(first_half, low, high)
    at = np.where(other > 0, np.bitwise_count(other - np.uint64(1)), 0) + np.where(first_half, 0, 32)
    return (np.bitwise_count(x) <= radius) & (at == variant)


def _edges(radius: int, most: int | None):
    """Rows (variant, part, fingerprint) in order of the first two -> rows (a, b, hot): edges, or members (variant, fingerprint) of a variant with too many."""

    def large(variant: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        classes = _Union(len(f))
        step = max(1, 2_000_000 // len(f))
        for i in range(0, len(f), step):
            a, b = np.nonzero(_linked(f[i : i + step, None], f[None, i:], variant, radius))
            classes.join(a + i, b + i)
        hung = np.nonzero(classes.root != np.arange(len(f)))[0]
        return f[hung], f[classes.root[hung]]

    def groups(variant: np.ndarray, part: np.ndarray, f: np.ndarray) -> Iterator[tuple]:
        """Of whole groups, none of which has too many."""
        same = (variant[1:] == variant[:-1]) & (part[1:] == part[:-1])
        inside = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        variant, part, f = variant[inside], part[inside], f[inside].view(np.uint64)
        starts = np.nonzero(np.concatenate([[True], (variant[1:] != variant[:-1]) | (part[1:] != part[:-1])]))[0] if len(f) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(f)))
        bit = variant >> 32
        few = np.repeat(sizes <= 24, sizes)
        v, p, g, k = variant[few], part[few], f[few], bit[few]
        for d in range(1, 24):
            if len(g) <= d:
                break
            near = (v[d:] == v[:-d]) & (p[d:] == p[:-d])
            if not near.any():
                break
            a, b = g[:-d][near], g[d:][near]
            hit = _linked(a, b, k[d:][near], radius)
            if hit.any():
                yield a[hit].view(np.int64), b[hit].view(np.int64), np.zeros(int(hit.sum()), bool)
        for s, n in zip(starts[sizes > 24], sizes[sizes > 24]):
            a, b = large(int(bit[s]), f[s : s + n])
            yield a.view(np.int64), b.view(np.int64), np.zeros(len(a), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the columns of the group that may go on in the next batch
        size, hot = 0, False

        def out(found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "hot"])

        def hold(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Members of the group that goes on; once it has too many, they are passed on as they come."""
            nonlocal size, hot
            held.append([c.copy() for c in columns])
            size += len(columns[0])
            if most is not None and size > most:
                hot = True
                yield from (out((variant, f, np.ones(len(f), bool))) for variant, _, f in held)
                held.clear()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size, hot
            if held:
                yield from map(out, groups(*[np.concatenate([h[i] for h in held]) for i in range(3)]))
            held.clear()
            size, hot = 0, False

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            variant, part, _ = columns
            starts = np.flatnonzero(np.concatenate([[at != (variant[0], part[0])], (variant[1:] != variant[:-1]) | (part[1:] != part[:-1])]))
            at = variant[-1], part[-1]
            first = starts[0] if len(starts) else batch.num_rows
            if first:
                yield from hold([c[:first] for c in columns])
            if len(starts):
                yield from close()
                if starts[-1] > first:
                    yield from map(out, groups(*[c[first : starts[-1]] for c in columns]))
                yield from hold([c[starts[-1] :] for c in columns])
        yield from close()

    return run


def links(found: DataFrame, radius: int = 3, most: int = 30_000) -> DataFrame:
    """Edges (a, b) that connect all linked fingerprints of ``found`` (different values of ``fingerprint``)."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves with one wildcard hold for a radius of 3 at most")
    schema = "a long, b long, hot boolean"
    rows = found.mapInArrow(_variants, "variant long, part long, fingerprint long")
    edges = written(rows.repartition("variant").sortWithinPartitions("variant", "part").mapInArrow(_edges(radius, most), schema), "simhash-edges")
    hot = edges.filter("hot").select(F.col("a").alias("variant"), F.col("b").alias("fingerprint"))
    if not hot.isEmpty():
        size = hot.groupBy("variant").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).alias("chunks"))
        pairs = (
            hot.join(size, "variant")
            .withColumn("own", F.pmod(F.xxhash64("fingerprint"), "chunks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("variant", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")).alias("part"), "fingerprint")
        )
        more = pairs.repartition("variant", "part").sortWithinPartitions("variant", "part").mapInArrow(_edges(radius, None), schema)
        edges = edges.filter("NOT hot").union(written(more, "simhash-hot"))
    return edges.select("a", "b")


def classes(docs: DataFrame, width: int, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (long), component_id: the least key of the component."""
    own = written(fingerprinted(docs, width, key, text), "simhash")
    first = own.groupBy("fingerprint").agg(F.min(key).alias("first"))
    known = least_of_class(first, "fingerprint", components(links(first.select("fingerprint"), radius)))
    return own.join(known, F.col("fingerprint") == F.col("of")).select(key, "fingerprint", "component_id")


def deduplicated(docs: DataFrame, width: int = 5, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the least of its class; rows that share a key stay or go together, rows without a key can't be told apart and stay."""
    own = fresh(docs, "gone")
    gone = classes(docs, width, radius, key, text).filter(F.col(key) > F.col("component_id")).select(F.col(key).alias(own)).distinct()
    return docs.join(gone, F.col(key) == F.col(own), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its component at 3 differing bits or fewer."""
    return classes(documents(spark, sf_dir), 3).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
