"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming search.

Texts are lower-cased words.  For each size that benchmark items have, every window of so many
words of every document gets a 64-bit SimHash of its weighted shingles: running counts of set
bits over a batch of documents give a window's counts as one difference, taken for all 64 bits
at once on planes that hold a binary digit of every count.  Fingerprints are split
into 4 blocks of 16 bits: two within RADIUS (15) bits differ by at most 3 bits in some
block.  Items are filed under all block values within 3 bits of their own, so looking up a
window's four block values returns every item of its size within the radius, and about 4 % of
the others.  What is within the radius is verified by exact weighted-shingle similarity (sum
of smaller over sum of larger counts).

The radius is the method's only loss: at a similarity of exactly 0.8 two fingerprints differ by
10 bits on average and by more than 15 in 2.4 % of pairs, at 0.85 in 0.3 %, at 0.9 in 3 of 10,000, at 0.92
in 1 of 20,000 (items of 25 to 80 shingles of equal weight).

The benchmark is dealt with in blocks of bounded size, each broadcast; documents are scanned
without a shuffle, whole, however long, once for each block.

Defined results: null and empty texts match nothing, nor do items without words; an item of
fewer than five words is one shingle; a text shorter than an item is one window; repeated rows
are judged each; items with equal texts are all reported; items whose item_id is null are
searched like others, and each that is found is reported with a null item_id; of windows
equally similar the first is reported; extra columns are kept by `decontaminated`, ignored by `leaks`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, in_blocks, mix, shingle_hashes, text_or_empty

BITS = 64
BLOCKS, BLOCK_BITS = 4, 16
#: Hamming radius of the search: BLOCKS * (NEAR_BITS + 1) - 1, so that no fingerprint within it is missed.
NEAR_BITS = 3
RADIUS = BLOCKS * (NEAR_BITS + 1) - 1
#: Items and characters of the benchmark in one broadcast.
ITEMS_AT_ONCE = 5_000
CHARS_AT_ONCE = 20_000_000
#: A size of at most so many items is looked through once a window's block values have hit.
LOOK_THROUGH = 64
#: Windows whose fingerprints are made at once; their counts stay in a core's cache.
WINDOWS_AT_ONCE = 16_384
#: Odd factor of the word hash, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
UNFACTOR = pow(FACTOR, -1, 1 << 64)


@cache
def _in_words() -> np.ndarray:
    """Which code points belong to words: letters, digits and the underline."""
    return np.array([chr(c).isalnum() or c == ord("_") for c in range(sys.maxunicode + 1)])


@cache
def _mixed_codes() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    return np.cumprod(np.r_[np.ones(1, np.uint64), np.full((1 << bits) - 1, base, np.uint64)])


def words_of(text: str | None) -> np.ndarray:
    """A hash for each lower-cased word: the sum of its mixed characters times powers of an odd factor, mixed again."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _in_words()[codes]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = change[::2], change[1::2]
    bits = max(12, int(len(codes)).bit_length())
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed_codes()[codes] * _powers(FACTOR, bits)[: len(codes)], out=total[1:])
    return mix((total[stop] - total[start]) * _powers(UNFACTOR, bits)[start])


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """SimHash from sums of signed bits, as 8 bytes a row."""
    return np.packbits(sums > 0, axis=1)


def running_counts(hashes: np.ndarray, out: np.ndarray) -> None:
    """out[1:] counts how often each bit is set up to each hash, from out[0] on; out wraps around."""
    n, rows = len(hashes), 128
    counts = np.zeros((-(-n // rows), rows, BITS), out.dtype)
    counts.reshape(-1, BITS)[:n] = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    for i in range(1, rows):  # all groups of rows at once, as sums down a column are slow
        counts[:, i] += counts[:, i - 1]
    counts[1:] += np.cumsum(counts[:-1, -1], axis=0, dtype=out.dtype)[:, None]
    np.add(counts.reshape(-1, BITS)[:n], out[0], out=out[1:])


def majorities(planes: np.ndarray, span: int, spare: np.ndarray) -> np.ndarray:
    """SimHashes of all runs of `span` hashes: the bits that are set in more than half of each.

    planes[j] has binary digit j of the running counts.  The difference of a window's ends is made digit
    after digit with its borrow, and so is that of the result and the least majority, whose last borrow tells.
    """
    n = planes.shape[1] - span
    differs, digit, borrow, enough = spare[:, :n]
    least, digits = span // 2 + 1, span.bit_length()
    lowest = (least & -least).bit_length() - 1  # below it no difference falls short
    for j in range(digits):
        last, first = planes[j, span:], planes[j, :n]
        np.bitwise_xor(last, first, out=differs)
        if j >= lowest:
            into = enough if j == lowest else digit
            if j:
                np.bitwise_xor(differs, borrow, out=into)
            else:
                np.copyto(into, differs)
            if j > lowest:
                (np.bitwise_and if least >> j & 1 else np.bitwise_or)(enough, digit, out=enough)
        if j == 0:
            np.bitwise_and(first, differs, out=borrow)
        elif j < digits - 1:
            # where the digits differ the first one's is borrowed, else the borrow stays
            np.bitwise_xor(borrow, first, out=digit)
            np.bitwise_and(digit, differs, out=digit)
            np.bitwise_xor(borrow, digit, out=borrow)
    return enough


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingle hashes; weights are counts."""
    keys, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


#: All differences of at most NEAR_BITS bits in a block.
_BALL = np.flatnonzero(np.bitwise_count(np.arange(1 << BLOCK_BITS)) <= NEAR_BITS).astype(np.uint16)
#: Bit b of byte b.
_BLOCK_BIT = np.frombuffer(bytes(1 << b for b in range(BLOCKS)), np.uint32)[0]


class Index:
    """Items of one size, filed under every block value near one of their own."""

    def __init__(self, size: int, keys: list, shingles: list[np.ndarray]):
        self.size, self.keys, self.shingles = size, keys, shingles
        self.width = min(size, SHINGLE_WORDS)
        self.span = size - self.width + 1
        self.held = [frozenset(s.tolist()) for s in shingles]
        self.prints = np.concatenate([packed(signed_bits(s).sum(0, dtype=np.int64)[None, :]) for s in shingles]).view(np.uint64).ravel()
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        near = blocks[:, :, None] ^ _BALL  # item, block, value
        self.occupied = np.zeros(1 << BLOCK_BITS, np.uint8)  # bit b: some item is filed there in block b
        self.values, self.items = [], []
        for b in range(BLOCKS):
            own = near[:, b].ravel()
            self.occupied[own] |= 1 << b
            if len(keys) > LOOK_THROUGH:
                order = np.argsort(own, kind="stable")
                self.values.append(own[order])
                self.items.append((order // len(_BALL)).astype(np.int32))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) for all fingerprints (four block values each) and items within RADIUS."""
        filed = np.take(self.occupied, prints, mode="clip").view(np.uint32) & _BLOCK_BIT
        rows = np.flatnonzero(filed != 0)
        mine = prints.view(np.uint64)[rows]
        if len(self.keys) <= LOOK_THROUGH:
            at, item = np.divmod(np.flatnonzero(np.bitwise_count(mine[:, None] ^ self.prints) <= RADIUS), len(self.keys))
            return rows[at], item
        found = []
        for b in range(BLOCKS):
            own = np.flatnonzero(filed[rows] >> np.uint32(9 * b) & np.uint32(1))  # bit b of byte b
            value = prints.reshape(-1, BLOCKS)[rows[own], b]
            first = np.searchsorted(self.values[b], value, "left")
            count = np.searchsorted(self.values[b], value, "right") - first
            at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            row, item = np.repeat(own, count), self.items[b][at]
            close = np.bitwise_count(mine[row] ^ self.prints[item]) <= RADIUS
            found.append(row[close] * len(self.keys) + item[close])
        pairs = np.unique(np.concatenate(found))
        return rows[pairs // len(self.keys)], pairs % len(self.keys)


class Benchmark:
    """Items by size; `search` finds them in a batch of texts."""

    def __init__(self, items: list[tuple[int | None, str]], near: float = NEAR):
        self.near = near
        by_size: dict[int, list] = {}
        for row, (item_id, text) in enumerate(items):
            w = words_of(text)
            if len(w):
                # items without an id are told apart by their place in the list
                by_size.setdefault(len(w), []).append(((item_id is None, row if item_id is None else item_id), shingle_hashes(w)))
        self.sizes = [Index(n, [k for k, _ in own], [s for _, s in own]) for n, own in sorted(by_size.items())]
        longest = max((i.span for i in self.sizes), default=1)
        self.digits = longest.bit_length()
        # counts may wrap around: differences of a window's counts are right as long as they fit
        self.counts = np.uint8 if self.digits <= 8 else np.uint16 if self.digits <= 16 else np.uint64

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, float, int, int]]]:
        """For each text, (item_id, similarity, first word, words) of the best window for each item that it holds."""
        words = [words_of(t) for t in texts]
        found: list[dict] = [{} for _ in texts]
        length = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(length)
        every = np.concatenate(words) if words else np.zeros(0, np.uint64)
        room = np.repeat(end, length) - np.arange(len(every))  # words up to the end of the text
        for width in sorted({i.width for i in self.sizes}):
            if len(every) < width:
                continue
            shingles = shingle_hashes(every, width)
            counts = np.zeros((len(shingles) + 1, BITS), self.counts)
            planes = np.zeros((self.digits, len(shingles) + 1), np.uint64)
            for a in range(0, len(shingles), WINDOWS_AT_ONCE):
                part = counts[a : a + WINDOWS_AT_ONCE + 1]
                running_counts(shingles[a : a + WINDOWS_AT_ONCE], part)
                for j in range(self.digits):
                    planes[j, a : a + len(part)] = np.packbits(part & self.counts(1 << j), axis=1).view(np.uint64).ravel()
            sizes = [i for i in self.sizes if i.width == width]
            self._windows(sizes, planes, shingles, room, end, found)
            for own in sizes:
                self._short_texts(own, counts, shingles, length, end, found)
        return [[(None if nameless else i, *best[nameless, i]) for nameless, i in sorted(best)] for best in found]

    def _windows(self, sizes: list[Index], planes, shingles, room, end, found) -> None:
        spare = np.empty((4, WINDOWS_AT_ONCE), np.uint64)
        # all sizes for a stretch of starts, as its planes are in the core's cache then
        for a in range(0, len(shingles), WINDOWS_AT_ONCE):
            for own in sizes:
                n = min(WINDOWS_AT_ONCE, len(shingles) - own.span + 1 - a)
                if n <= 0:
                    continue
                row, item = own.within(majorities(planes[:, a : a + own.span + n], own.span, spare).view(np.uint16))
                if not len(row):
                    continue
                inside = room[a + row] >= own.size  # a window over the end of a text is none
                for start, i in zip((a + row[inside]).tolist(), item[inside].tolist(), strict=True):
                    text = int(np.searchsorted(end, start, "right"))
                    self._verify(own, i, shingles[start : start + own.span], found[text], start - (int(end[text - 1]) if text else 0), own.size)

    def _short_texts(self, own: Index, counts, shingles, length, end, found) -> None:
        # shared weight is at most the text's, and the larger weights sum to the item's at least
        n = length - own.width + 1
        texts = np.flatnonzero((length < own.size) & (n > 0) & (n >= self.near * own.span - 1e-9))
        if not len(texts):
            return
        start = end[texts] - length[texts]
        row, item = own.within(np.packbits(counts[start + n[texts]] - counts[start] > (n[texts] // 2)[:, None]).view(np.uint16))
        for r, i in zip(row.tolist(), item.tolist(), strict=True):
            t = texts[r]
            self._verify(own, i, shingles[start[r] : start[r] + n[t]], found[t], 0, int(length[t]))

    def _verify(self, own: Index, item: int, window: np.ndarray, best: dict, first_word: int, words: int) -> None:
        # shared weight is at most the window's shingles that the item holds
        shared = sum(map(own.held[item].__contains__, window.tolist()))
        if shared < self.near * max(len(window), own.span) - 1e-9:
            return
        s = similarity(window, own.shingles[item])
        if s >= self.near and s > best.get(own.keys[item], (0.0,))[0]:
            best[own.keys[item]] = (s, first_word, words)


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of bounded size."""
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // ITEMS_AT_ONCE), -(-size.chars // CHARS_AT_ONCE))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


_loaded: dict = {}


def _benchmark(shared) -> Benchmark:
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Benchmark(shared.value)
    return _loaded[shared.id]


class _Shared:
    """A broadcast list of items with a name for the worker's cache."""

    def __init__(self, spark, items):
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @property
    def value(self):
        return self.held.value


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words for each benchmark item that a document holds."""
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for items in benchmark_blocks(benchmark):
        shared = _Shared(docs.sparkSession, items)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = _benchmark(shared)
            for b in in_blocks(batches):
                ids, texts = (c.to_pylist() for c in b.columns)
                hits = [(d, *m) for d, own in zip(ids, bench.search(texts), strict=True) for m in own]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = rows.mapInArrow(searched, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    at = docs.columns.index("text")
    for items in benchmark_blocks(benchmark):
        shared = _Shared(docs.sparkSession, items)

        def kept(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            bench = _benchmark(shared)
            for b in in_blocks(batches):
                yield b.filter(pa.array([not own for own in bench.search(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
