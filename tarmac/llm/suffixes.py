"""Suffix-array dedup: byte strings of ``length`` (50) that also start in a document of smaller id are removed.

Only text that can repeat is sorted. Each window of 50 bytes has a key, the least hash of its 20-byte grams; neighbouring windows of one key form a run, about 15 windows long, and equal windows have equal keys. Documents are taken in blocks, dealt by a hash of id and text, so blocks are of like size whatever the ids are. In a first round a block asks for each of its keys, a row each; a Spark aggregate finds those that two blocks ask for, and they come back. In a second round blocks send the runs of repeated keys, each different run once and with the least id that has it, to the bucket of the key, so that all occurrences of a window meet in one bucket. The runs of a key that has more than about ``hot`` different ones (such as a phrase that a third of all documents have between different words) are sent window by window instead, dealt by the window itself. Each block counts its different runs of a key in steps of ``STEP``, so what makes a key hot is how much would meet in its bucket, not how many blocks there are.

A bucket holds one shelf of keys or, where a block would have more than ``rows`` buckets to write to, several, which are sorted one after the other; so a block's rows stay as large, and as many, however large the table is. From ``rows`` times ``SHELVES`` shelves on (65 GB of text) rows shrink instead, as a bucket is in one task's memory.

A shelf is taken in shards of bounded size. In each shard a suffix array over its runs is made by Larsson-Sadakane refinement: suffixes are sorted by a few symbols, then only groups not yet told apart are sorted again by the ranks of what follows, twice as deep each time. Kasai's common prefixes of neighbours, computed for the irreducible ones and carried on to the others, cut the array into classes of equal windows. Across shards, classes are merged one shard after the other, by binary search of a shard's class strings among those merged so far. A window is removed if its class has a document of smaller id; one bit for each window goes back to its block.

A passage that a third of all documents share is sent once by each block, however many documents have it. A block has a row for each of its keys in the first round, one more for each ``STEP`` different runs of a key, and at most one for a key in the second, so rows grow with the input. The documents are shuffled once and all three passes read that exchange.

Equality of windows is by their bytes; hashes only group and deal. Matches never cross documents.

Defined cases: a null or empty text has no bytes; texts shorter than ``length`` are kept; ids may be of any type that has an order, and nulls come before all others; rows that share an id are one document to each other (none of them has the smaller id); rows that repeat are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tarmac.llm.common import dealt, documents, in_order, total_bytes
from tarmac.llm.windows import lists_of, spans_of

_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 64, 257, np.uint64)
#: A number for each byte, and an odd base.
_BYTE, _BASE = _RANDOM[:256], _RANDOM[256] | np.uint64(1)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b))]) for b in (self.base, self.inverse))
        return self.up, self.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _texts(table: pa.Table, text: str) -> list[bytes]:
    return [b if b is not None else b"" for b in table.column(text).cast(pa.binary()).to_pylist()]


def packed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=count).view(bool)


#: Bytes that are hashed at once; bytes of runs in a shard at most; bytes of input for each shelf of runs, few enough for a suffix array to stay in the caches.
SLICE, SHARD, SHELF = 1 << 18, 1_500_000, 500_000
#: Shelves in a bucket at most; different runs of a key in a block that count as one more row.
SHELVES, STEP = 64, 8
GRAM = 20


# ---------------------------------------------------------------- suffix arrays


def _in_order(high: np.ndarray, low: np.ndarray, low_bits: int, at: np.ndarray, at_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``at`` by (high, low, at), and where (high, low) is new. Sorted as one number where the bits suffice, which numpy does several times faster."""
    if int(high.max(initial=0)).bit_length() + low_bits + at_bits < 64:
        packed = (high << (low_bits + at_bits)) | (low << at_bits) | at
        packed.sort()
        at, both = packed & ((1 << at_bits) - 1), packed >> at_bits
        return at, np.concatenate([[True], both[1:] != both[:-1]])
    order = np.lexsort((at, low, high))
    high, low = high[order], low[order]
    return at[order], np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. ``rest``: how many symbols each suffix has until its string's end; a string that ends comes first, equal suffixes are in order of position."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = n.bit_length()
    # symbols as small numbers, 0 for a string's end; as many of them at first as fit beside a position
    used = np.bincount(text, minlength=256) > 0
    width = int(used.sum()).bit_length()
    depth = max(1, (63 - bits) // width)
    symbol = np.zeros(n + depth, np.int64)
    symbol[:n] = np.cumsum(used)[text]
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key = (key << width) | np.where(rest > i, symbol[i : i + n], 0)
    sa, new = _in_order(key, np.zeros(n, np.int64), 0, np.arange(n), bits)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where each group starts
    rank = np.empty(n, np.int64)
    rank[sa] = head
    while True:
        # slots of groups that have more than one suffix; one shorter than the depth equals its whole group
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone & (rest[sa] >= depth))
        if not len(open_):
            return sa
        at = sa[open_]
        later = np.where(rest[at] > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        at, differ = _in_order(head[open_], later, bits, at, bits)
        sa[open_] = at
        new[open_] |= differ
        head[open_] = np.maximum.accumulate(np.where(differ, open_, 0))
        rank[at] = head[open_]
        depth *= 2


def common_prefixes(text: np.ndarray, rest: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: symbols that each suffix of ``sa`` shares with the one before it.

    In order of text, a suffix shares at least one less than the suffix before it does. Where the symbols before a pair are equal it is one less exactly; only the other pairs are compared.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    starts = np.concatenate([[True], rest[1:] != rest[:-1] - 1])
    carried = (i > 0) & (before > 0) & ~starts & ~starts[np.maximum(before, 0)]
    carried &= text[i - 1] == text[np.maximum(before, 1) - 1]
    # the pair one step to the left must be neighbours themselves
    carried[1:] &= before[:-1] == before[1:] - 1
    a = np.flatnonzero(~carried & (before >= 0))
    b = before[a]
    most = np.minimum(rest[a], rest[b])
    shared = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    depth = 0
    while len(going):
        going = going[most[going] > depth]
        going = going[text[a[going] + depth] == text[b[going] + depth]]
        depth += 1
        shared[going] = depth
    found = np.zeros(n, np.int64)
    found[a] = shared + a
    return np.maximum(np.maximum.accumulate(found) - i, 0)[sa] * (before[sa] >= 0)


# ---------------------------------------------------------------- runs of windows


class Runs:
    """The runs of some documents, in order: document, offset in it, windows, key, and a hash of the whole."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length, gram = texts, length, min(GRAM, length)
        powers, held, some = _Powers(_BASE), 0, []
        parts: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            nonlocal held
            if not some:
                return
            x = np.frombuffer(b"".join(texts[d][a:b] for d, a, b in some), np.uint8)
            some_d, some_a, some_b = (np.array(c) for c in zip(*some))
            base = np.concatenate([[0], np.cumsum(some_b - some_a)])
            some.clear()
            held = 0
            if len(x) < length:
                return
            up, down = powers.to(len(x))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * down[: len(x)])])
            g = _mixed((total[gram:] - total[:-gram]) * up[: len(x) - gram + 1])
            width, spanned = length - gram + 1, 1
            while spanned < width:
                step = min(spanned, width - spanned)
                g = np.minimum(g[:-step], g[step:])
                spanned += step
            # windows that stay within a piece
            valid = np.zeros(len(g) + 1, bool)
            piece = np.zeros(len(g) + 1, np.int8)
            ends = np.maximum(base[1:] - length + 1, base[:-1])
            np.add.at(piece, np.minimum(base[:-1], len(g)), 1)
            np.add.at(piece, np.minimum(ends, len(g)), -1)
            valid = np.cumsum(piece[:-1]) > 0
            first = valid.copy()
            first[1:] &= (g[1:] != g[:-1]) | ~valid[:-1]
            first[base[:-1][base[:-1] < len(g)]] &= True
            inner = base[1:-1]
            inner = inner[inner < len(g)]
            first[inner] = valid[inner]
            stop = ~valid
            stop |= first
            start = np.flatnonzero(first)
            edge = np.append(np.flatnonzero(stop), len(g))
            end = edge[np.searchsorted(edge, start, side="right")]
            of = np.searchsorted(base, start, side="right") - 1
            # least hashes are small numbers; mixed once more they spread over the buckets
            parts.append((some_d[of], start - base[of] + some_a[of], end - start, _mixed(g[start]), _mixed((total[end + length - 1] - total[start]) * up[start])))

        for d, t in enumerate(texts):
            for a in range(0, len(t) - length + 1, SLICE):
                b = min(len(t), a + SLICE + length - 1)
                some.append((d, a, b))
                held += b - a
                if held >= SLICE:
                    flush()
        flush()
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        self.doc, self.at, self.windows, self.key, self.whole = (np.concatenate([p[i] for p in parts] or [empty[i]]) for i in range(5))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys; and a key again for each ``STEP`` different runs that it has."""
        different = ~pd.Series(self.whole).duplicated().to_numpy()
        counts = pd.Series(self.key[different]).value_counts(sort=False)
        keys = counts.index.to_numpy()
        return keys, np.repeat(keys, counts.to_numpy() // STEP)

    def strings(self, doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> list[bytes]:
        more = self.length - 1
        texts = self.texts
        return [texts[d][a : a + n + more] for d, a, n in zip(doc.tolist(), at.tolist(), windows.tolist())]


class Offer:
    """The different strings of a block's chosen runs, in order of their shelves and then of first occurrence; each window of a hot run is a string of its own. A bucket is ``together`` shelves."""

    def __init__(self, runs: Runs, chosen: np.ndarray, hot: np.ndarray, shelves: int, together: int):
        plain, split = np.flatnonzero(chosen & ~hot), np.flatnonzero(chosen & hot)
        n = runs.windows[split]
        doc = np.concatenate([runs.doc[plain], np.repeat(runs.doc[split], n)])
        at = np.concatenate([runs.at[plain], _ragged(runs.at[split], n)])
        windows = np.concatenate([runs.windows[plain], np.ones(int(n.sum()), np.int64)])
        strings = runs.strings(doc, at, windows)
        dealt = np.concatenate([runs.key[plain], np.array([xxh64_intdigest(s) for s in strings[len(plain) :]], np.uint64)])
        shelf = (((dealt >> np.uint64(32)) * np.uint64(shelves)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((at, doc, shelf))
        self.doc, self.at, self.windows, shelf = doc[order], at[order], windows[order], shelf[order]
        self.code, self.different = pd.factorize(np.array([*[strings[i] for i in order.tolist()], None], dtype=object)[:-1]) if strings else (np.zeros(0, np.int64), np.zeros(0, object))
        # equal strings have equal shelves, so codes rise from shelf to shelf
        self.first = np.flatnonzero(~pd.Series(self.code).duplicated().to_numpy())
        self.buckets, starts = np.unique(shelf[self.first] // together, return_index=True)
        self.shelf = (shelf[self.first] % together).astype(np.uint8)  # within the bucket
        self.starts = np.append(starts, len(self.first))  # where each bucket's strings start among the different ones


# ---------------------------------------------------------------- classes


def _classes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of ``strings``, in order: class numbers; and, by class in sorted order, the class string and one position. """
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    rest = np.repeat(ends, sizes) - np.arange(len(text))
    sa = suffix_array(text, rest)
    shared = common_prefixes(text, rest, sa)
    window = rest[sa] >= length
    # a class is broken wherever any neighbour on the way shares less
    cut = np.cumsum(shared < length)[window]
    number = np.cumsum(np.concatenate([[True], cut[1:] != cut[:-1]])) - 1 if len(cut) else cut
    out = np.empty(len(text), np.int64)
    out[sa[window]] = number
    one = sa[window][np.concatenate([[True], number[1:] != number[:-1]])] if len(cut) else sa[:0]
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    names = np.lib.stride_tricks.sliding_window_view(padded, length)[one]
    return out[rest >= length], np.ascontiguousarray(names).view(f"S{length}").ravel(), sizes - length + 1


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[0] .. starts[0] + sizes[0] - 1, then of the next, and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def settled(strings: list[bytes], order: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each window of each string, string by string: whether a string of smaller ``order`` has it; and how many windows each string has. Equal strings are given once, with their least order."""
    shards, some, held = [], [], 0
    for i, s in enumerate(strings):
        some.append(i)
        held += len(s)
        if held >= shard or i == len(strings) - 1:
            code, names, windows = _classes([strings[j] for j in some], length)
            own = np.repeat(order[some], windows)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, code, own)
            shards.append((code, names, windows, own, least))
            some, held = [], 0
    known, best = (shards[0][1], shards[0][4]) if shards else (np.zeros(0, f"S{length}"), np.zeros(0, np.int64))
    for _, names, _, _, least in shards[1:]:
        # names are in order, so a search goes on where the last one ended
        at, same = _found(known, names)
        np.minimum.at(best, at[same], least[same])
        known, best = np.insert(known, at[~same], names[~same]), np.insert(best, at[~same], least[~same])
    bits = [best[_found(known, names)[0]][code] < own for code, names, _, own, _ in shards]
    return np.concatenate(bits or [np.zeros(0, bool)]), np.concatenate([x[2] for x in shards] or [np.zeros(0, np.int64)])


def _found(known: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``names`` are among ``known``, or would stand, and whether they are there."""
    at = np.searchsorted(known, names)
    return at, (known[np.minimum(at, len(known) - 1)] == names) & (at < len(known)) if len(known) else np.zeros(len(names), bool)


def layout(total: int, shelf: int, rows: int) -> tuple[int, int]:
    """Shelves for ``total`` bytes, and how many of them share a bucket: as few as leave a block at most ``rows`` buckets."""
    shelves = max(1, -(-total // shelf))
    return shelves, min(SHELVES, -(-shelves // rows))


def _own_bits(chosen: np.ndarray, hot: np.ndarray) -> bytes:
    return packed(np.concatenate([chosen, hot]))


def deduplicated_substrings(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", block_bytes: int = 8_000_000, shard: int = SHARD, hot: int = 20_000, shelf: int = SHELF, rows: int = 2048) -> DataFrame:
    """key, n_bytes, n_removed, intervals (array of start, end in bytes), kept (binary)."""
    total, kind = total_bytes(docs, text), docs.schema[key].dataType
    blocks, (shelves, together) = max(1, -(-total // block_bytes)), layout(total, shelf, rows)
    placed = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), dealt([F.col(key), F.xxhash64(text)], blocks).alias("block"))

    def read(table: pa.Table) -> tuple[int, pa.Table, list[bytes], Runs]:
        own = in_order(table, "key", "body")
        texts = _texts(own, "body")
        return own.column("block")[0].as_py() if own.num_rows else 0, own, texts, Runs(texts, length)

    def ask(table: pa.Table) -> pa.Table:
        block, _, _, runs = read(table)
        keys, again = runs.asked()
        # rows that only count have a block below 0
        return pa.table({"block": pa.array(np.repeat([block, -1], [len(keys), len(again)]), pa.int64()), "asked": pa.array(np.concatenate([keys, again]).view(np.int64))})

    def offer(table: pa.Table, known: pa.Table) -> pa.Table:
        block, own, _, runs = read(table)
        of_key = pd.Series(known.column("many").to_numpy(zero_copy_only=False), index=known.column("asked").to_numpy().view(np.uint64))
        asked = of_key.reindex(runs.key)
        chosen = asked.notna().to_numpy() | pd.Series(runs.key).duplicated(keep=False).to_numpy()
        is_hot = asked.fillna(False).to_numpy().astype(bool)
        offered = Offer(runs, chosen, is_hot, shelves, together)
        least = own.column("key").combine_chunks().take(pa.array(offered.doc[offered.first]))
        squeeze = zstandard.ZstdCompressor(level=1)
        sizes, shelf_of, strings = [], [], []
        for lo, hi in zip(offered.starts[:-1], offered.starts[1:]):
            some = offered.different[lo:hi]
            sizes.append(np.array([len(s) for s in some], np.uint32).tobytes())
            shelf_of.append(np.bincount(offered.shelf[lo:hi], minlength=together).astype(np.uint32).tobytes() if together > 1 else b"")
            strings.append(squeeze.compress(b"".join(some)))
        # a row that settles nothing tells the last pass which runs were chosen
        n = len(offered.buckets)
        return pa.table({
            "block": pa.array(np.full(n + 1, block), pa.int64()), "bucket": pa.array([*offered.buckets.tolist(), -1 - block], pa.int64()), "sizes": pa.array([*sizes, b""], pa.binary()), "shelves": pa.array([*shelf_of, b""], pa.binary()),
            "keys": pa.ListArray.from_arrays(pa.array([*offered.starts.tolist(), int(offered.starts[-1])], pa.int32()), least), "strings": pa.array([*strings, _own_bits(chosen, is_hot)], pa.binary()),
        })

    def settle(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["block", "bucket", "strings"]).rename_columns(["block", "bucket", "flags"])
        strings: list[bytes] = []
        counts, places = [], []
        for sizes, shelf_of, squeezed in zip(*(table.column(c).to_pylist() for c in ("sizes", "shelves", "strings"))):
            sizes = np.frombuffer(sizes, np.uint32)
            body, ends = zstandard.ZstdDecompressor().decompress(squeezed), np.cumsum(sizes).tolist()
            strings += [body[a:b] for a, b in zip([0, *ends], ends)]
            counts.append(len(sizes))
            places.append(np.repeat(np.arange(together), np.frombuffer(shelf_of, np.uint32)) if together > 1 else np.zeros(len(sizes), np.int64))
        orders = _ranks(pa.concat_arrays([c.flatten() for c in table.column("keys").chunks]))
        code, _ = pd.factorize(np.array([*strings, None], dtype=object)[:-1])
        least = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code, orders)
        pick = np.flatnonzero(~pd.Series(code).duplicated().to_numpy())  # by code
        of = np.concatenate(places)[pick]
        by_shelf = np.argsort(of, kind="stable")
        parts = [settled([strings[i] for i in pick[some]], least[some], length, shard) for some in np.split(by_shelf, np.flatnonzero(np.diff(of[by_shelf])) + 1)]
        bits, ordered = (np.concatenate([p[i] for p in parts]) for i in range(2))
        starts, windows = np.empty(len(pick), np.int64), np.empty(len(pick), np.int64)
        starts[by_shelf], windows[by_shelf] = np.cumsum(ordered) - ordered, ordered
        # where a smaller id has the whole string, all its windows are repeats
        answer = bits[_ragged(starts[code], windows[code])] | np.repeat(orders != least[code], windows[code])
        ends = np.concatenate([[0], np.cumsum(windows[code])])[np.cumsum([0, *counts])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array([packed(answer[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary())})

    def remove(table: pa.Table, flags: pa.Table) -> pa.Table:
        _, own, texts, runs = read(table)
        found = dict(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
        size = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        step = np.zeros(int(base[-1]) + 1, np.int32)
        (told,) = [v for k, v in found.items() if k < 0] or [_own_bits(np.zeros(len(runs.key), bool), np.zeros(len(runs.key), bool))]
        both = unpacked(told, 2 * len(runs.key))
        offered = Offer(runs, both[: len(runs.key)], both[len(runs.key) :], shelves, together)
        if len(offered.code):
            windows = offered.windows[offered.first]  # of each different string
            starts = np.concatenate([[0], np.cumsum(windows)])
            bits = np.zeros(int(starts[-1]), bool)
            for b, lo, hi in zip(offered.buckets.tolist(), starts[offered.starts[:-1]], starts[offered.starts[1:]]):
                bits[lo:hi] = unpacked(found[b], int(hi - lo))
            rank = _ranks(own.column("key").combine_chunks())[offered.doc]
            later = rank > rank[offered.first][offered.code]
            at, n = base[offered.doc] + offered.at, offered.windows
            np.add.at(step, at[later], 1)
            np.add.at(step, at[later] + n[later] + length - 1, -1)
            some = np.flatnonzero(~later)
            hit = _ragged(at[some], n[some])[bits[_ragged(starts[offered.code[some]], n[some])]]
            np.add.at(step, hit, 1)
            np.add.at(step, hit + length, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        of, a, b = spans_of(gone, size)
        removed = np.bincount(of, b - a, len(texts)).astype(np.int64) if len(of) else np.zeros(len(texts), np.int64)
        spans = np.searchsorted(of, np.arange(len(texts) + 1))
        kept = []
        for i, t in enumerate(texts):
            lo, hi = spans[i], spans[i + 1]
            kept.append(t if lo == hi else b"".join(t[x:y] for x, y in zip([0, *b[lo:hi].tolist()], [*a[lo:hi].tolist(), len(t)])))
        return pa.table({"key": own.column("key"), "n_bytes": pa.array(size), "n_removed": pa.array(removed), "intervals": lists_of(of, a, b, len(texts)), "kept": pa.array(kept, pa.binary())})

    long = lambda n: T.StructField(n, T.LongType(), False)
    binary = lambda n: T.StructField(n, T.BinaryType())
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField("key", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", spans_type), T.StructField("kept", T.BinaryType())])
    by_block = placed.groupBy("block")
    # shuffled once: the count and the join back read the same exchange
    asked = by_block.applyInArrow(ask, T.StructType([long("block"), long("asked")])).repartition("asked")
    a_block = F.col("block") >= 0
    shared = asked.groupBy(F.col("asked").alias("shared")).agg(F.min(F.when(a_block, F.col("block"))).alias("one"), F.max("block").alias("other"), F.sum(F.when(a_block, 1).otherwise(STEP)).alias("runs"))
    shared = shared.filter("one < other").select("shared", "one", (F.col("runs") > hot).alias("many"))
    # rows that only count go by a condition on both sides: the planner would filter below the exchange, and make it twice
    known = asked.join(shared, (F.col("asked") == F.col("shared")) & (F.col("block") >= F.col("one"))).select("block", "asked", "many")
    offers = by_block.cogroup(known.groupBy("block")).applyInArrow(offer, T.StructType([long("block"), long("bucket"), binary("sizes"), binary("shelves"), T.StructField("keys", T.ArrayType(kind)), binary("strings")]))
    flags = offers.groupBy("bucket").applyInArrow(settle, T.StructType([long("block"), long("bucket"), binary("flags")]))
    return by_block.cogroup(flags.groupBy("block")).applyInArrow(remove, out).withColumnRenamed("key", key)


def _ranks(keys: pa.Array) -> np.ndarray:
    """The place of each key among the different ones, nulls first; equal keys have one place."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    known = pc.unique(keys)
    place = np.empty(len(known), np.int64)
    place[pc.array_sort_indices(known, null_placement="at_start").to_numpy()] = np.arange(len(known))
    return place[pc.index_in(keys, known).to_numpy(zero_copy_only=False)] if len(keys) else place


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a document of smaller id are removed from every document."""
    return deduplicated_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("intervals").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
