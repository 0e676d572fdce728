"""Byte-level BPE encoding and decoding.

Encoding looks pre-tokens up in two tiers. A minimal perfect hash over the vocabulary (hash and displace: one displacement for each small group of keys, no empty slot) resolves every pre-token that is a token as a whole. The others are merged by rank: the bytes form a linked list of ids, a heap holds the ranks of adjacent pairs, and stale pairs are skipped, so a pre-token of n bytes takes n log n steps, whatever its length. Which pairs merge to which token is a table over the vocabulary, made once in a worker.

The vocabulary is a file of (base64 token, rank) lines whose path is a parameter. The driver reads it and broadcasts the tables; they are as large as the vocabulary and do not grow with the data. Texts are encoded in slices of a few MB, so memory does not follow the batch or the longest text. ``coded`` encodes and decodes in one pass of one worker.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids in a list, ids that the vocabulary does not have and lists that are null decode to nothing; rows that repeat are encoded each; an empty table gives an empty result; columns named in ``keep`` are carried through and no others.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tarmac.llm.common import documents, small_batches

#: Code points of text, and pre-tokens of one very long text, that are encoded at once.
SLICE_CHARS, SLICE_PIECES = 4_000_000, 800_000


def vocabulary(path: str) -> list[bytes]:
    """Tokens by rank; None-like gaps are empty."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max((int(rank) for _, rank in pairs), default=-1) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Slot of each key in 0..n-1, all different; a key outside the set gets some slot, so the caller compares."""

    def __init__(self, keys: list[bytes], group: int = 4):
        self.n, self.groups = max(1, len(keys)), max(1, -(-len(keys) // group))
        for self.seed in range(100):
            if self._place(keys):
                return
        raise ValueError("keys repeat")

    def _hash(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter((xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        return (low * np.uint64(self.groups)) >> np.uint64(32), high, (high * np.uint64(0x9E3779B1) + low) & np.uint64(0xFFFFFFFF) | np.uint64(1)

    def _place(self, keys: list[bytes]) -> bool:
        group, first, step = self._hash(keys)
        self.moved = np.zeros(self.groups, np.uint64)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(self.groups + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        free = np.ones(self.n, bool)
        for g in np.argsort(-sizes, kind="stable"):
            if not sizes[g]:
                break
            own = order[starts[g] : starts[g + 1]]
            a, b = first[own][:, None], step[own][:, None]
            for tried in range(0, 1 << 22, 1024):
                slots = self._slot(a, b, np.arange(tried, tried + 1024, dtype=np.uint64))
                good = free[slots].all(0)
                if len(own) > 1:
                    s = np.sort(slots, 0)
                    good &= (s[1:] != s[:-1]).all(0)
                if good.any():
                    at = int(good.argmax())
                    self.moved[g] = tried + at
                    free[slots[:, at]] = False
                    break
            else:
                return False
        return True

    def slots(self, keys: list[bytes]) -> np.ndarray:
        group, first, step = self._hash(keys)
        return self._slot(first, step, self.moved[group]).astype(np.int64)

    def _slot(self, first: np.ndarray, step: np.ndarray, moved: np.ndarray) -> np.ndarray:
        mixed = first + step * moved
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.n)


class Tables:
    """What an encoder needs, built once on the driver."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.name = blake2b(b"\0".join([base64.b64encode(t) for t in tokens]) + pattern.encode(), digest_size=16).hexdigest()
        ranks = [i for i, t in enumerate(tokens) if t]
        self.hash = PerfectHash([tokens[i] for i in ranks])
        self.slot_rank = np.zeros(self.hash.n, np.int32)
        self.slot_rank[self.hash.slots([tokens[i] for i in ranks])] = ranks

    @classmethod
    def read(cls, path: str, pattern: str) -> Tables:
        """Of a vocabulary file; made once for a file that stays as it is."""
        return _read(path, pattern, os.stat(path).st_mtime_ns)


@lru_cache(2)
def _read(path: str, pattern: str, changed: int) -> Tables:
    return Tables(vocabulary(path), pattern)


class Encoder:
    #: Results of the second tier that a worker keeps, in two generations: what is not asked for in one is dropped in the next.
    MOST_KEPT = 600_000

    def __init__(self, tables: Tables):
        self.t, self.pattern = tables, regex.compile(tables.pattern)
        rank = {t: i for i, t in enumerate(tables.tokens) if t}
        self.byte = [rank.get(bytes([b])) for b in range(256)]
        #: left id << 32 | right id -> the id of both together.
        self.pairs = {a << 32 | b: i for t, i in rank.items() for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None}
        self.whole = None not in self.byte
        #: The rank of each pair of bytes, a row for each first one.
        self.two = [[self.pairs.get(a << 32 | b, -1) if a is not None and b is not None else -1 for b in self.byte] for a in self.byte]
        self.kept: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no token itself."""
        if (found := self.kept.get(piece)) is not None:
            return found
        found = self.older.get(piece)
        if found is None:
            found = self._merged(piece)
        if len(piece) <= 64:
            if len(self.kept) >= self.MOST_KEPT // 2:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = found
        return found

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        pair, n = self.pairs.get, len(piece)
        ids = list(map(self.byte.__getitem__, piece))
        if not self.whole and None in ids:
            raise KeyError(f"the vocabulary lacks a byte of {piece!r}")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # of each place: the rank of its pair, -1 if it has none; a heap entry with another rank is stale
        two = self.two
        ranks = [two[a][b] for a, b in zip(piece, piece[1:])]
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != r:
                continue
            ids[i] = r
            j = after[i]
            ids[j] = ranks[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranks[i] = found = pair(r << 32 | ids[k], -1)
                if found >= 0:
                    heappush(heap, found << 32 | i)
            else:
                ranks[i] = -1
            if (h := before[i]) >= 0:
                ranks[h] = found = pair(ids[h] << 32 | r, -1)
                if found >= 0:
                    heappush(heap, found << 32 | h)
        return tuple([i for i in ids if i >= 0])

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, unique = pd.factorize(np.array(pieces, dtype=object))
        keys = [u.encode() for u in unique]
        found = self.t.slot_rank[self.t.hash.slots(keys)].tolist()
        tokens = self.t.tokens
        each = [(r,) if tokens[r] == k else self.merged(k) for r, k in zip(found, keys)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum()))
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return flat[at], n

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of ``texts``: how many texts, their ids, and how many ids each text has."""
        batch: list[str] = []
        chars = 0
        for text in texts:
            text = text or ""
            if batch and chars + len(text) > SLICE_CHARS:
                yield self._some(batch)
                batch, chars = [], 0
            batch.append(text)
            chars += len(text)
        if batch:
            yield self._some(batch)

    def _some(self, texts: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            matches = self.pattern.finditer(texts[0])
            parts = []
            while some := [m.group() for m in islice(matches, SLICE_PIECES)]:
                parts.append(self.ids(some)[0])
            ids = np.concatenate(parts)
            return 1, ids, np.array([len(ids)])
        pieces: list[str] = []
        ends = [0]
        for t in texts:
            pieces += self.pattern.findall(t)
            ends.append(len(pieces))
        ids, n = self.ids(pieces)
        total = np.concatenate([[0], np.cumsum(n)])
        return len(texts), ids, np.diff(total[np.array(ends)])


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.n, self.tokens = len(tokens), pa.array([*tokens, b""], pa.binary())

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids: all tokens side by side, cut where the lists end."""
        ends = lists.offsets.to_numpy()
        values = lists.values.slice(ends[0], ends[-1] - ends[0])
        known = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, self.n)), False)
        tokens = self.tokens.take(pc.if_else(known, values, self.n))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy(), dtype=np.int64)])
        offsets = pa.array(size[ends - ends[0]], pa.int64())
        joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, offsets.buffers()[1], tokens.buffers()[2]])
        return joined.cast(pa.binary())


#: The last encoder and decoder of this worker: their tables and what the second tier keeps serve its next tasks too.
_KEPT: dict[str, tuple[Encoder, Decoder]] = {}


def _coders(tables: Tables) -> tuple[Encoder, Decoder]:
    if tables.name not in _KEPT:
        _KEPT.clear()
        _KEPT[tables.name] = Encoder(tables), Decoder(tables.tokens)
    return _KEPT[tables.name]


def _coding(docs: DataFrame, tables: Tables, keep: tuple[str, ...], text: str, names: tuple[str, ...]) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    added = [T.StructField(names[0], T.ArrayType(T.IntegerType())), *[T.StructField(n, T.BinaryType()) for n in names[1:]]]
    schema = T.StructType([*[docs.schema[k] for k in keep], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(shared.value)
        for batch in batches:
            at = 0
            for rows, ids, n in encoder.encode(t.as_py() for t in batch.column(len(keep))):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                own = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(len(keep))], lists, *[decoder.decode(lists) for _ in names[1:]]], [*keep, *names])
                at += rows

    return docs.select(*keep, F.col(text).alias(f"{names[0]}_text")).mapInArrow(run, schema)


def encoded(docs: DataFrame, tables: Tables, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "ids") -> DataFrame:
    """The columns in ``keep`` and ``out``: array of int, the ids of ``text``."""
    return _coding(docs, tables, keep, text, (out,))


def coded(docs: DataFrame, tables: Tables, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """The columns in ``keep``, ``ids`` and ``back``: binary, the bytes that the ids decode to."""
    return _coding(docs, tables, keep, text, (ids, back))


def decoded(docs: DataFrame, tables: Tables, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns in ``keep`` and ``out``: binary, the bytes of ``ids``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _coders(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], decoder.decode(batch.column(len(keep)))], [*keep, out])

    return docs.select(*keep, F.col(ids).alias(f"{out}_ids")).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Ids of every document, decoded again; digests of both."""
    import public_tokenizers

    tables = Tables.read(vocabulary_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded(documents(spark, sf_dir), tables).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
