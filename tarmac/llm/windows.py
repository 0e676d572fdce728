"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Words are told apart by 128 bits of a cryptographic hash (BLAKE2b) of their bytes. A window's hash is the polynomial of its words' hashes at a fixed random base, modulo the prime 2^61 - 1, twice with independent bases and independent halves of the words' hashes. Neither texts made for it nor chance make two different windows equal: among n windows of w words, n^2 / 2 pairs collide with a probability of at most (w / 2^61)^2 each, together below 10^-6 for the 2 x 10^13 windows of 100 TB.

Documents are taken in blocks dealt by a hash of their ids, so blocks are of like size however ids are spread and whatever their type. Windows are counted in two rounds, both of them rows in ordinary joins and aggregates, whose number grows with the words and with nothing else:

1. Each window has a key, the least hash among its runs of ``length`` / 4 words. Equal windows have equal keys, and neighbours mostly share one, so a block asks for one key in about eight windows: rows (block, key). Keys that two blocks ask for come back.
2. Of each different window under such a key, a block offers a row (hash, id of the first document that has it, place). Spark counts the rows of each hash and takes the least id; offers that another row precedes are repeats, and their places come back to the block.

A block's own repeats are found in the block. Repeats that overlap are merged into maximal intervals, which are removed. However many documents share a passage, each block asks and offers it once, so no key has more rows than there are blocks. The documents are shuffled once, and all three passes read that exchange.

Defined cases: a null, empty or blank text has no words; a text shorter than a window has no windows and is kept; ids of any type order documents, nulls before all others and rows that share an id by their texts (such rows are in one block); rows that repeat are each returned, and the later one's windows all repeat the first's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import dealt, documents, in_order, total_bytes

PRIME = (1 << 61) - 1
#: The polynomials' bases, one for each lane.
_BASES = [int(b) % (PRIME - 2) + 2 for b in np.random.default_rng(20240229).integers(0, 1 << 62, 2)]
#: Words that are hashed at once: few enough for the arrays to stay in the caches.
SLICE = 1 << 16
_U = np.uint64


def _reduced(x: np.ndarray) -> np.ndarray:
    """x < 2^64 modulo the prime."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo the prime, for x and c below it."""
    high, low, c_high, c_low = x >> _U(32), x & _U(0xFFFFFFFF), _U(c >> 32), _U(c & 0xFFFFFFFF)
    middle = high * c_low + low * c_high  # below 2^62, and stands for so many 2^32
    product = low * c_low
    total = ((high * c_high) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (product & _U(PRIME)) + (product >> _U(61))
    return _reduced(total)


def rolled(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """The polynomial of each ``length`` consecutive values, by doubling: of two stretches side by side, that of both."""
    if len(x) < length:
        return x[:0]
    h, size = x, 1
    for bit in bin(length)[3:]:
        h = _reduced(times(h[: len(h) - size], pow(base, size, PRIME)) + h[size:])
        size *= 2
        if bit == "1":
            h = _reduced(times(h[:-1], base) + x[size : size + len(h) - 1])
            size += 1
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all; parted by space and 9 to 13."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    parts = pc.ascii_split_whitespace(texts)
    words, ends = parts.flatten(), parts.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return np.diff(before[ends - ends[0]]), words.filter(pa.array(real))


class Hasher:
    """Hashes of windows, in one of two lanes."""

    def __init__(self, length: int, lane: int = 0):
        self.length, self.lane = length, lane

    def lanes(self, words: pa.Array) -> np.ndarray:
        """128 bits of each word, as two columns."""
        coded = words.dictionary_encode()
        known = b"".join([blake2b(w, digest_size=16).digest() for w in coded.dictionary.cast(pa.binary()).to_pylist()])
        return np.frombuffer(known, _U).reshape(-1, 2)[coded.indices.to_numpy()]

    def of_words(self, lanes: np.ndarray) -> np.ndarray:
        """Of every ``length`` consecutive words, whether or not a text ends between them."""
        parts = [rolled(_reduced(lanes[at : at + SLICE + self.length - 1, self.lane]), self.length, _BASES[self.lane]) for at in range(0, max(1, len(lanes) - self.length + 1), SLICE)]
        return np.concatenate(parts)

    def word_hashes(self, text: bytes) -> np.ndarray:
        return self.lanes(words_of(_strings([text]))[1])[:, self.lane]

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; of all windows in order, the index of the first word among all words, and the hash."""
        counts, words = words_of(_strings(texts))
        first = starts_of(counts, self.length)
        return counts, first, self.of_words(self.lanes(words))[first]


def starts_of(counts: np.ndarray, length: int) -> np.ndarray:
    """The first words of all windows, among all words."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(len(ends)) + length <= ends)


def _strings(texts: list[bytes]) -> pa.Array:
    return pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    spanned = 1
    while spanned < width:
        step = min(spanned, width - spanned)
        x = np.minimum(x[:-step], x[step:])
        spanned += step
    return x


class Block:
    """The windows of a block's texts: words of each text, the windows' first words, and their keys."""

    def __init__(self, texts: pa.Array, length: int):
        self.counts, self.words = words_of(texts)
        self.length, self.lanes = length, Hasher(length).lanes(self.words)
        self.first = starts_of(self.counts, length)
        gram = max(1, length // 4)
        # any function of the words will do for keys; the last bit is left for ``often``
        h, size = self.lanes[:, 0].copy(), 1
        for _ in range(gram - 1):
            h = h[:-1] * _U(0x9E3779B97F4A7C15) + self.lanes[size:, 0] if len(h) > 1 else h[:0]
            size += 1
        self.grams, self.width = _mixed(h) & ~_U(1), length - gram + 1

    def keys(self) -> np.ndarray:
        return (least_of(self.grams, self.width) if len(self.grams) >= self.width else self.grams[:0])[self.first]

    def often(self) -> np.ndarray:
        """Whether the words that gave a window its key occur again in the block; else the window can't."""
        again = pd.Series(self.grams).duplicated(keep=False).to_numpy()
        return (least_of(self.grams | again, self.width)[self.first] & _U(1)).astype(bool) if len(self.first) else np.zeros(0, bool)

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both lanes of the chosen windows."""
        return tuple(Hasher(self.length, lane).of_words(self.lanes)[self.first[chosen]] if len(chosen) else np.zeros(0, _U) for lane in (0, 1))

    def repeated(self) -> np.ndarray:
        """Whether each window occurs earlier in the block."""
        out = np.zeros(len(self.first), bool)
        some = np.flatnonzero(self.often())
        low, high = self.hashes(some)
        out[some] = pd.DataFrame({"a": low, "b": high}).duplicated().to_numpy()
        return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64), pa.int64())


def _block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py() if table.num_rows else 0


def _texts(table: pa.Table) -> pa.Array:
    found = table.column("body").combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def spans_of(gone: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``gone``, cut where a text ends: text, start and end in it."""
    base = np.concatenate([[0], np.cumsum(counts)])
    edge = np.concatenate([[False], gone, [False]])
    change = np.flatnonzero(edge[1:] != edge[:-1])
    inner = base[1:-1]
    inner = inner[(inner > 0) & (inner < len(gone))]
    cut = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
    start, end = np.sort(np.concatenate([change[::2], cut])), np.sort(np.concatenate([change[1::2], cut]))
    of = np.searchsorted(base, start, side="right") - 1
    return of, start - base[of], end - base[of]


def lists_of(of: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"]),
    )


def deduplicated_windows(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """key, n_words, n_removed, intervals (array of start, end in words), kept_text (the kept words joined by one blank)."""
    blocks = max(1, -(-total_bytes(docs, text) // block_bytes))
    placed = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), dealt([F.col(key)], blocks).alias("block"))
    kind = docs.schema[key].dataType

    def ask(table: pa.Table) -> pa.Table:
        keys = pd.unique(Block(_texts(table), length).keys())
        return pa.table({"block": pa.array(np.full(len(keys), _block_of(table)), pa.int64()), "asked": _longs(keys)})

    def offer(table: pa.Table, known: pa.Table) -> pa.Table:
        own = in_order(table, "key", "body")
        block = Block(_texts(own), length)
        shared = pd.Series(block.keys()).isin(known.column("asked").to_numpy().view(_U)).to_numpy()
        some = np.flatnonzero(shared & ~block.repeated()) if shared.any() else np.zeros(0, np.int64)
        low, high = block.hashes(some)
        of = np.searchsorted(np.cumsum(block.counts), block.first[some], side="right")
        return pa.table({"low": _longs(low), "high": _longs(high), "key": own.column("key").combine_chunks().take(pa.array(of)), "place": pa.array((_block_of(own) << 32) + block.first[some], pa.int64())})

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        own = in_order(table, "key", "body")
        block = Block(_texts(own), length)
        counts = block.counts
        again = np.concatenate([block.first[block.repeated()], found.column("first").to_numpy()])
        step = np.zeros(int(counts.sum()) + 1, np.int64)
        np.add.at(step, again, 1)
        np.add.at(step, again + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        of, start, end = spans_of(gone, counts)
        base = np.concatenate([[0], np.cumsum(counts)])
        left = np.concatenate([[0], np.cumsum(~gone)])[base]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), block.words.filter(pa.array(~gone))), " ")
        return pa.table({"key": own.column("key"), "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(counts - np.diff(left), pa.int64()), "intervals": lists_of(of, start, end, len(counts)), "kept_text": kept})

    out = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_text", T.StringType())])
    offered = T.StructType([T.StructField("low", T.LongType(), False), T.StructField("high", T.LongType(), False), T.StructField("key", kind), T.StructField("place", T.LongType(), False)])
    by_block = placed.groupBy("block")
    # each is shuffled once by its hash; the count and the join back read the same exchange
    asked = by_block.applyInArrow(ask, T.StructType([T.StructField("block", T.LongType(), False), T.StructField("asked", T.LongType(), False)])).repartition("asked")
    shared = asked.groupBy(F.col("asked").alias("shared")).agg(F.min("block").alias("one"), F.max("block").alias("other")).filter("one < other").select("shared")
    known = asked.join(shared, F.col("asked") == F.col("shared")).select("block", "asked")
    offers = by_block.cogroup(known.groupBy("block")).applyInArrow(offer, offered).repartition("low", "high")
    counted = offers.groupBy(F.col("low").alias("l"), F.col("high").alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.count("key").alias("named"), F.min("key").alias("least"), F.min("place").alias("one"), F.max("place").alias("other"))
    # by places, not by the count, and with no condition that could move below the exchange: so the count and the join back read one
    counted = counted.filter("one < other").select("l", "h", "rows", "named", "least")
    # a block offers a window once and rows that share an id are in one block, so no two rows of a window are of one id
    later = F.when(F.col("key").isNull(), False).otherwise((F.col("named") < F.col("rows")) | (F.col("key") > F.col("least")))
    found = offers.join(counted, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))).filter(later)
    found = found.select(F.shiftright("place", 32).alias("block"), F.col("place").bitwiseAND((1 << 32) - 1).alias("first"))
    return by_block.cogroup(found.groupBy("block")).applyInArrow(remove, out).withColumnRenamed("key", key)


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 20 words are removed from every document."""
    return deduplicated_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
