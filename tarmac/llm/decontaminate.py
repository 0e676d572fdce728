"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ in e = n // ``tolerance`` edits. It is cut into e + 1 pieces, of which any occurrence within e edits holds one unchanged; an Aho-Corasick automaton finds all exact piece hits in one pass over a text. Each hit fixes where the item would lie; that stretch, e characters wider on both sides, is verified with Myers' bit-parallel distance.

Items and texts are compared in a common form, made on their bytes: letters of all scripts case-folded (after NFC, so that an accented letter is the same however it is composed), and every run of other ASCII characters than letters and digits as one blank.

Items are taken in blocks of at most ``block_chars`` characters. A block's size is known before it is broadcast, whatever the size of the benchmark, and texts are scanned once for each block; they are never shuffled.

Defined cases: a null or empty text holds nothing; items that are null or empty in the common form identify nothing; items of fewer than ``least_chars`` characters in the common form are found without edits only, as whole words; an item that occurs several times in a text has its best occurrence reported; items that repeat are reported each under their own id, null ids too; rows that repeat are each reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from unicodedata import normalize

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarmac.llm.common import documents, fresh, small_batches

_FORM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def common_form(text: str | None) -> str:
    """One character for each byte, so that offsets count bytes."""
    text = text or ""
    if not text.isascii():
        # folding may leave letters and marks apart that compose
        text = normalize("NFC", normalize("NFC", text).casefold())
    return b" ".join(text.encode("utf-8", "replace").translate(_FORM).split()).decode("latin-1")


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 adjacent stretches of 0..n, as equal as can be."""
    return [(n * i // (errors + 1), n * (i + 1) // (errors + 1)) for i in range(errors + 1)]


class Pattern:
    """Myers' bit-parallel search; one Python integer holds a column."""

    def __init__(self, pattern: str):
        self.n, self.bits = len(pattern), {}
        for i, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance to any stretch of ``text``, and the first end of such a stretch."""
        n, bits = self.n, self.bits
        full, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score = full, 0, n
        least, end = n, 0
        for j, c in enumerate(text):
            eq = bits.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up) & full
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            up = mh | ~(xv | ph) & full
            down = ph & xv
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str, int]], least_chars: int = 0):
        """items: number, common form, errors allowed; those of fewer than ``least_chars`` characters are found as whole words only, with no errors."""
        items = [(k, form, 0 if len(form) < least_chars else e) for k, form, e in items]
        self.least_chars = least_chars
        self.items = {k: (form, e) for k, form, e in items}
        self.patterns: dict[int, Pattern] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, form, e in items:
            for a, b in pieces(len(form), e):
                owners.setdefault(form[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, own)
        if owners:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item number -> distance, start at the earliest, end of its best occurrence in the common form."""
        form = common_form(text)
        best: dict[int, tuple[int, int, int]] = {}
        if not self.items or not form:
            return best
        seen: set[tuple[int, int]] = set()
        for at, owners in self.automaton.iter(form):
            for k, b in owners:
                start = at + 1 - b  # of the item, if no edit lies before the piece
                if best.get(k, (1,))[0] == 0 or (k, start) in seen:
                    continue
                seen.add((k, start))
                item, e = self.items[k]
                if len(item) < self.least_chars and (form[max(0, start - 1) : start].strip() or form[at + 1 : at + 2].strip()):
                    continue
                if form.startswith(item, max(0, start)) and start >= 0:
                    best[k] = (0, start, start + len(item))
                    continue
                low = max(0, start - e)
                if (p := self.patterns.get(k)) is None:
                    p = self.patterns[k] = Pattern(item)
                distance, end = p.best(form[low : start + len(item) + e])
                if distance <= e and (distance, low + end) < (best[k][0], best[k][2]) if k in best else distance <= e:
                    best[k] = (distance, max(0, low + end - len(item) - distance), low + end)
        return best


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, tolerance: int, least_chars: int, block_chars: int) -> Iterator[tuple[list, list]]:
    """Of each block: (number, common form, errors allowed) and the keys by number."""
    items = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_chars))
    block = F.pmod(F.xxhash64("t", "k"), F.lit(blocks))
    for i in range(blocks):
        rows = [(r.k, common_form(r.t)) for r in items.filter(block == i).orderBy("k", "t").toLocalIterator()]
        rows = [(k, form) for k, form in rows if form]
        yield [(n, form, len(form) // tolerance if len(form) >= least_chars else 0) for n, (_, form) in enumerate(rows)], [k for k, _ in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", tolerance: int = 16, least_chars: int = 32, block_chars: int = 8_000_000) -> DataFrame:
    """One row for each document and item found in it: key, item_key (with an underscore behind it if both have one name), distance, allowed, start, end (offsets in bytes of the common form)."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(fresh(docs.select(key), item_key.lower()) if item_key.lower() == key.lower() else item_key, benchmark.schema[item_key].dataType),
        T.StructField("distance", T.IntegerType()), T.StructField("allowed", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    small_batches(docs.sparkSession)
    found = []
    for items, keys in _blocks(benchmark, item_key, item_text, tolerance, least_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((items, pa.array(keys, to_arrow_type(schema[1].dataType))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, keys = shared.value
            matcher = Matcher(items, least_chars)
            for batch in batches:
                hits = [(row, k, *hit) for row, t in enumerate(batch.column(1)) for k, hit in matcher.found(t.as_py()).items()]
                if hits:
                    row, k, distance, start, end = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), keys.take(pa.array(k)), pa.array(distance, pa.int32()), pa.array([matcher.items[x][1] for x in k], pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        schema.names,
                    )

        found.append(docs.select(F.col(key), F.col(text)).mapInArrow(run, schema))
    return reduce(DataFrame.union, found)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", tolerance: int = 16, least_chars: int = 32, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item; judged row by row, so neither ids nor a shuffle are needed."""
    small_batches(docs.sparkSession)
    where = docs.columns.index(text)
    for items, _ in _blocks(benchmark, item_key, item_text, tolerance, least_chars, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least_chars)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.found(t.as_py()) for t in batch.column(where)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, with at most one edit in 16 characters."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
