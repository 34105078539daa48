"""LM scoring: a hierarchical Pitman-Yor language model, sampled and applied as Spark jobs.

Restaurants.  The root serves all words over a uniform base of V+1 dishes; its children are the
contexts, which share it as parent: one for the start of a text and one for each word before that
training rows hold.  Customers of a context restaurant are its training tokens, those of the root the
contexts' tables.  (With context_customers above 1, words seen less often in training share one
restaurant.  A bitmap of CONTEXT_BITS bits marks the words with a restaurant of their own; one that falls
on a marked bit by chance has one too, and one without customers predicts as the root does.)

Gibbs sampling of the Chinese-restaurant seating.  What predictions need of a seating is the
number of tables t of each dish.  With discount 1/2 its distribution given c customers has a
closed form: seatings of c customers at t tables weigh (2c-t-1)! / ((t-1)! (c-t)!) 2^t.  Three
latent variables make all dishes independent, so that every dish of every restaurant is drawn
from its exact conditional distribution in one pass:
    mass of a restaurant   ~ Gamma(strength / discount + its tables)
    the root's weights     ~ Dirichlet(customers - discount * tables; the rest goes to the base)
    t of dish w            : weight(t+1) / weight(t) = 2 mass P(w) (c-t) / (t (2c-t-1))
That ratio falls with t, so t is drawn by rejection under a flat top and two geometric tails, at
the same cost for two customers and for a billion.  (What the root's base part gives a single
word is taken by its mean.)  After BURN_IN sweeps, the predictive probabilities of SAMPLES sweeps are
averaged: P(w | u) = mean of (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P(w).
Every draw is a function of (context, word, sweep), so the model doesn't depend on how rows are
dealt out.  The strengths (one for all contexts, one for the root) are drawn in each sweep from their
conditional distribution over a grid.

Pairs (context, word, n) are dealt by context and hash in arrays, added up before, in TURNS scans of the texts; only dishes
of two customers or more are in the sweeps, as one customer always has one table.  A pair that occurs once
keeps the key of its row, and so do held-out tokens of pairs met once or never: they are scored from
these rows, by what contexts and words tell.  Of pairs met twice or more, the HEAD_PAIRS most frequent ones (a
bounded table) are scored where the text is, and the others where both texts and scores are dealt by the pair, in
arrays; a table of bits (of fixed size, which only saves work) keeps most other tokens out of that.

Tokens: A-Z lower-cased, words are runs of other characters than blanks (space, tab to
carriage return), then one end token.  Words are held as 64-bit hashes.  Training rows are
those whose crc32(doc_id as text) mod 5 is not 1.

Defined results: null and empty texts are the end token alone; rows that share a doc_id are
scored each; without training rows nothing is known and every token has probability
1/(V+1) = 1; a very long text is scored whole, in memory that grows with it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_by, drop_table, in_blocks, mix, shuffles_freed

FOLDS, HELD_OUT_FOLD = 5, 1
#: Training tokens behind a word from which it has a restaurant of its own: every word of the training rows has.
CONTEXT_CUSTOMERS = 1
CONTEXT_BITS = 26
#: Words and pairs known where the texts are scored.
HEAD_WORDS, HEAD_PAIRS = 500_000, 500_000
#: Turns, by hash, in which pairs are counted: each is a scan of the texts and a shuffle of its share.
TURNS = 2
DISCOUNT = 0.5  # other discounts have no closed form
#: Strengths that contexts (all alike) and the root may have; they are drawn in each sweep too.
STRENGTHS = 2.0 ** np.arange(-2, 17)
BURN_IN, SAMPLES = 1, 2
SEED = 11
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a newline
START = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
RARE = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n\n"))


def signed(x: np.uint64) -> int:
    return int(x.astype(np.int64))


#: Words of more bytes are hashed one at a time.
LONG_WORD = 64
_OF_LENGTH = mix(np.arange(1, LONG_WORD + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _tokens_of_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, one after another, each with its end, and how many each text has.

    Text i is data[offsets[i] : offsets[i + 1]], in UTF-8.  Words are hashed eight bytes at a time, all words at once.
    """
    solid = (data - np.uint8(9) > 4) & (data != 32)  # neither tab to carriage return nor a space
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    first[at] = solid[at]
    at = offsets[1:][filled] - 1
    last[at] = solid[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data | (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)  # A-Z lower-cased
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    h = _OF_LENGTH[np.minimum(length, LONG_WORD + 1)]
    some, left = np.flatnonzero(length <= LONG_WORD), None
    place, left = start[some], length[some]
    own = h[some]
    h_of = some
    while len(place):
        own = mix(own ^ (eight[place] & _FIRST_BYTES[np.minimum(left, 8)]))
        h[h_of] = own
        more = np.flatnonzero(left > 8)
        place, left, own, h_of = place[more] + 8, left[more] - 8, own[more], h_of[more]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]].tobytes())
    upto = np.searchsorted(start, offsets[1:])
    words = np.diff(np.r_[0, upto])
    out = np.empty(len(h) + len(words), np.uint64)
    ends = upto + np.arange(len(words))
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = h, END
    return out, words + 1


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, the end included."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _tokens_of_bytes(data, np.array([0, len(data)]))[0]


def block_tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of an Arrow array of texts, one after another, and how many each text has."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return _tokens_of_bytes(data, offsets - offsets[0])


#: Bytes of text whose tokens are made at a time, so that they stay in the processor's cache.
BLOCK_BYTES = 500_000


def _folded(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT_FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("held_out", F.coalesce("text", F.lit(""))))  # rows of one key have one score


#: Tokens whose counts a task adds up before it sends them on.
HELD_TOKENS = 1_000_000


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows and how often each occurs; sorted by a single key.

    Two keys are sorted by half of the bits of each: rows that agree in those alone may be told
    apart more than once, so counts of a row are still to be added up.
    """
    half = np.uint64(32)
    order = np.argsort(keys[0] if len(keys) == 1 else keys[0] >> half << half | keys[1] >> half)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.r_[first, len(order)])


def _counted(rows: DataFrame, columns: list[str], keys) -> DataFrame:
    """Counts of the key columns that keys(tokens) gives, over the training rows."""
    import pyarrow as pa

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            own = [np.concatenate(k) for k in zip(*held, strict=True)]
            at, c = distinct(*own)
            return pa.RecordBatch.from_arrays([*(pa.array(k[at].view(np.int64)) for k in own), pa.array(c)], names=[*columns, "n"])

        for b in in_blocks(batches):
            for t in b.column("text").to_pylist():
                held.append(keys(tokens(t)))
                n += len(held[-1][0])
                if n > HELD_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    found = rows.where("not held_out").select("text").mapInArrow(counted, ", ".join(f"{c} long" for c in columns) + ", n long")
    return found.groupBy(*columns).agg(F.sum("n").alias("n"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the training rows."""
    return _counted(rows, ["word"], lambda toks: (toks,))


class Contexts:
    """The restaurant of each token: a word before with a marked bit, the start, or the rare words' one."""

    def __init__(self, marked: np.ndarray | None = None):
        self.marked = marked  # a bit for each value of a word's first CONTEXT_BITS bits; without it all words are marked

    @classmethod
    def of_counts(cls, counts: DataFrame, customers: int) -> Contexts:
        place = F.shiftrightunsigned("word", 64 - CONTEXT_BITS)
        frequent = counts.where(F.col("n") >= customers).select((F.shiftright(place, 5)).alias("at"), F.expr(f"shiftleft(1l, int(shiftrightunsigned(word, {64 - CONTEXT_BITS}) & 31))").alias("bit"))
        words = frequent.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^21 rows at most, whatever the corpus
        marked = np.zeros(1 << (CONTEXT_BITS - 5), np.uint32)
        marked[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
        return cls(marked)

    def of(self, toks: np.ndarray, starts=0) -> np.ndarray:
        """Contexts of the tokens of one text, or of several that begin at `starts`."""
        out = np.empty(len(toks), np.uint64)
        before = toks[:-1]
        if self.marked is None:
            out[1:], out[starts] = before, START
            return out
        place = before >> np.uint64(64 - CONTEXT_BITS)
        own = self.marked[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1)
        out[1:] = np.where(own > 0, before, RARE)
        out[starts] = START
        return out


def _distinct_pairs(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For records with n > 0 (training) or 0 (held-out): a training record of each distinct pair that has one,
    the sum of n, and for every record its pair's sum."""
    order = np.argsort(pair)
    new = np.r_[True, np.diff(pair[order]) != 0]
    group = np.cumsum(new) - 1
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    of_group = np.full(len(total), -1)
    counted = np.flatnonzero(n[order] > 0)
    of_group[group[counted]] = order[counted]
    of_record = np.empty_like(n)
    of_record[order] = total[group]
    return of_group[of_group >= 0], total[of_group >= 0], of_record


def part_of(ctx: np.ndarray, pair: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each pair: a context's pairs go to an eighth of the partitions at most.

    So rows of a context lie together and compress; the most frequent one, with a share f of all
    pairs, makes a partition larger by 8 f of the usual size at most, however many there are.
    """
    spread = np.uint64(max(1, parts // 8))
    return mix(ctx + (pair >> np.uint64(40)) % spread) % np.uint64(parts)


#: What a row of packed_occurrences holds arrays of, with the types of its columns.
MET_TWICE, MET_ONCE, BY_CONTEXT, BY_WORD = range(4)
PACKED = {
    MET_TWICE: {"ctx": np.int64, "word": np.int64, "n": np.int64},
    MET_ONCE: {"ctx": np.int64, "word": np.int64, "n": np.int8, "key": np.int64},
    BY_CONTEXT: {"ctx": np.int64, "c": np.int64, "singles": np.int64, "tables": np.int64},
    BY_WORD: {"word": np.int64, "k": np.int64, "singles": np.int64, "root_c": np.int64},
}
PACKED_SCHEMA = "kind int, a binary, b binary, c binary, d binary"
#: Entries of a packed row.
PACKED_ROWS = 25_000


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(batch, column: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def _slices(part: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(p, a, b): where the rows of each partition are in a sorted array of partitions."""
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, int(bounds[p]), int(bounds[p + 1])


def _small(places: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Of values, those that places point to, and places among these, in 16 bits if they fit."""
    used = np.zeros(len(values), bool)
    used[places] = True
    own = (np.cumsum(used) - 1)[places]
    few = values[used]
    return _bytes(own.astype(np.uint16 if len(few) <= 1 << 16 else np.int32)), _bytes(few)


def _large(places, values, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(values, kind)
    return np.frombuffer(places, np.uint16 if len(values) <= 1 << 16 else np.int32), values


def packed_occurrences(rows: DataFrame, contexts, turn: int = 0) -> DataFrame:
    """The pairs of this turn in arrays, as PACKED tells; contexts is a broadcast of Contexts.

    MET_TWICE: training pairs, n times.  MET_ONCE: n = 1 for one that occurs once, in the row `key`; 0 and -1 for a token of the
    held-out row `key` whose pair the training rows hold never or once.  BY_CONTEXT and BY_WORD: sums over training
    pairs of the partition.  Pairs are dealt by context and hash, in arrays, as
    counted in up to HELD_TOKENS tokens; held-out tokens whose pair is met twice there in training stay behind.
    """
    import pyarrow as pa

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent_names = ["part", "ctx", "word", "n", "doc", "keys"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, n = [], [], 0

        def flush():
            pair, ctx, word, doc, training = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            pairs, total, of_record = _distinct_pairs(pair, training)
            asked = np.flatnonzero((training == 0) & (of_record < 2))
            at, count = np.r_[pairs, asked], np.r_[total, np.zeros(len(asked), np.int64)]
            part = part_of(ctx[at], pair[at], parts)
            order = np.argsort(part << np.uint64(48) | ctx[at] >> np.uint64(16))  # neighbours share contexts, so they compress
            at, count, part = at[order], count[order].astype(np.int32), part[order]
            ctx, word, doc, own = ctx[at], word[at], doc[at], np.concatenate(keys)
            for p, a, b in _slices(part, parts):
                once = count[a:b] < 2
                at_keys, few = _small(doc[a:b][once], own)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in (_bytes(ctx[a:b]), _bytes(word[a:b]), _bytes(count[a:b]), at_keys, few))], names=sent_names)

        for b in in_blocks(batches, BLOCK_BYTES):
            toks, lengths = block_tokens(b.column("text"))
            ctx = contexts.value.of(toks, np.cumsum(lengths) - lengths)
            pair = pair_keys(ctx, toks)
            here = np.flatnonzero((pair >> np.uint64(32)) % np.uint64(TURNS) == turn)
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32) + sum(map(len, keys)), lengths)
            training = np.repeat(1 - b.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            held.append([x[here] for x in (pair, ctx, toks, doc, training)])
            keys.append(b.column("key").to_numpy())
            n += len(here)
            if n > HELD_TOKENS:
                yield from flush()
                keys, n = [], 0
        if n:
            yield from flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for i in range(b.num_rows):
                n = _array(b, "n", i, np.int32)
                doc, keys = _large(b.column("doc")[i].as_buffer(), b.column("keys")[i].as_buffer())
                key = np.zeros(len(n), np.int64)
                key[n < 2] = keys[doc]
                held.append((_array(b, "ctx", i, np.uint64), _array(b, "word", i, np.uint64), n, key))
        if not held:
            return
        ctx, word, n, key = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        n = n.astype(np.int64)
        pairs, total, of_record = _distinct_pairs(pair_keys(ctx, word), n)

        def packed(kind: int, **columns):
            size = len(columns[next(iter(columns))])
            for a in range(0, size, PACKED_ROWS):
                blobs = [_bytes(columns[c][a : a + PACKED_ROWS].astype(t, copy=False)) for c, t in PACKED[kind].items()]
                blobs += [None] * (4 - len(blobs))
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["kind", "a", "b", "c", "d"])

        def sums(of: np.ndarray):
            order = np.argsort(of)
            own = of[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            return own[first], np.add.reduceat(total[order], first), np.add.reduceat((total == 1).astype(np.int64)[order], first), np.diff(np.r_[first, len(own)])

        if len(pairs):
            for kind, of in ((BY_CONTEXT, ctx[pairs]), (BY_WORD, word[pairs])):
                yield from packed(kind, **dict(zip(PACKED[kind], sums(of), strict=True)))
        asked = np.flatnonzero((n == 0) & (of_record < 2))
        at, count = np.r_[pairs, asked], np.r_[total, -of_record[asked]]
        order = np.argsort(ctx[at])
        at, count = at[order], count[order]
        twice, once = np.flatnonzero(count > 1), np.flatnonzero(count < 2)
        yield from packed(MET_TWICE, ctx=ctx[at[twice]], word=word[at[twice]], n=count[twice])
        yield from packed(MET_ONCE, ctx=ctx[at[once]], word=word[at[once]], n=count[once], key=key[at[once]])

    sent = rows.select("held_out", "key", "text").mapInArrow(dealt, "part int, ctx binary, word binary, n binary, doc binary, keys binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(counted, PACKED_SCHEMA)


def unpacked(packed: DataFrame, kind: int) -> DataFrame:
    """The entries of packed rows, all of this kind, a row each."""
    import pyarrow as pa

    columns = PACKED[kind]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_array(b, x, i, t).astype(np.int64, copy=False)) for x, t in zip("abcd", columns.values(), strict=False)], names=[*columns])

    return packed.select(*"abcd"[: len(columns)]).mapInArrow(opened, ", ".join(f"{c} long" for c in columns))


def occurrences(rows: DataFrame, contexts, turn: int = 0) -> DataFrame:
    """(ctx, word, n, key) of the pairs of this turn: MET_TWICE (key: 0) and MET_ONCE of packed_occurrences."""
    import pyarrow as pa

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, kind in enumerate(b.column("kind").to_pylist()):
                if kind in (MET_TWICE, MET_ONCE):
                    x = {c: _array(b, p, i, t).astype(np.int64) for p, (c, t) in zip("abcd", PACKED[kind].items(), strict=False)}
                    yield pa.RecordBatch.from_pydict({"ctx": x["ctx"], "word": x["word"], "n": x["n"], "key": x.get("key", np.zeros_like(x["n"]))})

    return packed_occurrences(rows, contexts, turn).mapInArrow(opened, "ctx long, word long, n long, key long")


def packed_turns(rows: DataFrame, contexts) -> list[dict[int, DataFrame]]:
    """The packed occurrences of each turn, a table for each kind; the shuffle of one turn is held at a time."""
    with shuffles_freed(rows.sparkSession):
        return [cut_by(packed_occurrences(rows, contexts, turn), "kind", PACKED) for turn in range(TURNS)]


def all_occurrences(rows: DataFrame, contexts) -> list[DataFrame]:
    """The occurrences of each turn."""
    return [unpacked(turn[MET_TWICE], MET_TWICE).withColumn("key", F.lit(0).cast("long")).unionByName(unpacked(turn[MET_ONCE], MET_ONCE)) for turn in packed_turns(rows, contexts)]


def pair_counts(rows: DataFrame, contexts) -> DataFrame:
    """(ctx, word, n) over the training rows; contexts is a broadcast of Contexts."""
    return reduce(DataFrame.unionByName, all_occurrences(rows, contexts)).where("n > 0").select("ctx", "word", "n")


# ---- draws that are functions of a key


class Draws:
    """Independent streams of random numbers, one for each key."""

    def __init__(self, *keys):
        state = np.uint64(SEED)
        for k in keys:
            state = mix(np.asarray(k).astype(np.int64).view(np.uint64) + mix(state + np.uint64(0x9E3779B97F4A7C15) * np.ones(1, np.uint64)))
        self.state, self.n = state, 0

    def uniform(self, at=slice(None)) -> np.ndarray:
        """The next number in (0, 1) of the streams `at`."""
        self.n += 1
        x = mix(self.state[at] + np.uint64(0x9E3779B97F4A7C15) * np.full(1, self.n, np.uint64))
        return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """Gamma(shape, 1) by Marsaglia and Tsang's rejection."""
        boost = np.where(shape < 1, self.uniform() ** (1 / np.maximum(shape, 1e-9)), 1.0)
        d = np.where(shape < 1, shape + 1, shape) - 1 / 3
        out, left = np.zeros(len(shape)), np.arange(len(shape))
        while len(left):
            x = np.sqrt(-2 * np.log(self.uniform(left))) * np.cos(2 * np.pi * self.uniform(left))
            v = (1 + x / np.sqrt(9 * d[left])) ** 3
            u = self.uniform(left)
            ok = (v > 0) & (np.log(u) < 0.5 * x * x + d[left] * (1 - v + np.log(np.where(v > 0, v, 1))))
            out[left[ok]] = d[left[ok]] * v[ok]
            left = left[~ok]
        return out * boost


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0 by Stirling's series."""
    shift = np.where(x < 8, 8.0, 0.0)
    y = x + shift
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(y)
    for k in range(8):
        product *= np.where(shift > 0, x + k, 1.0)
    return series - np.log(product)


#: Up to so many customers tables are drawn from their summed weights.
FEW_CUSTOMERS = 8


def tables_of(customers: np.ndarray, mass: np.ndarray, draws: Draws) -> np.ndarray:
    """Tables t of 1..c for dishes with c customers, where weight(t+1) / weight(t) = 2 mass (c-t) / (t (2c-t-1)).

    mass is the restaurant's mass times the parent's probability of the dish.  Weights are log-concave:
    the mode is a root of a quadratic; to both sides of a stretch around it they lie below geometric tails.
    """
    c = customers.astype(np.float64)
    out = np.ones(len(c), np.int64)
    # few customers: the weights are summed up one by one
    few = np.flatnonzero((customers > 1) & (customers <= FEW_CUSTOMERS))
    u = draws.uniform(few)
    if len(few):
        own, m = c[few], mass[few]
        weights = [np.ones(len(few))]
        for t in range(1, int(own.max())):
            weights.append(weights[-1] * (2 * m * np.maximum(own - t, 0) / (t * np.maximum(2 * own - t - 1, 1))))
        upto = np.cumsum(weights, axis=0)
        out[few] = 1 + (upto[:-1] <= u * upto[-1]).sum(axis=0)
    live = np.flatnonzero(customers > FEW_CUSTOMERS)
    if not len(live):
        return out
    c, m = c[live], np.maximum(mass[live], 1e-300)

    def ratio(t):
        return 2 * m * (c - t) / (t * np.maximum(2 * c - t - 1, 1))

    # 2 m (c - t) = t (2c - t - 1)
    b = 2 * c - 1 + 2 * m
    root = 4 * m * c / (b + np.sqrt(np.maximum(b * b - 8 * m * c, 0)))
    mode = np.clip(np.ceil(root), 1, c)
    curve = 1 / mode + 1 / np.maximum(c - mode, 1) - 1 / np.maximum(2 * c - mode - 1, 1)
    spread = np.ceil(1 / np.sqrt(np.maximum(curve, 1e-12)))
    low, high = np.maximum(1, mode - spread), np.minimum(c, mode + spread)

    def log_weight(t, c, m):
        return log_gamma(2 * c - t) - log_gamma(c - t + 1) - log_gamma(t) + t * np.log(2 * m)

    top = log_weight(mode, c, m)
    # the greatest weight is at the mode or, by rounding, beside it
    for beside in (-1, 1):
        top = np.maximum(top, log_weight(np.clip(mode + beside, 1, c), c, m))
    up = np.where(high < c, ratio(high), 0.0)
    down = np.where(low > 1, 1 / np.maximum(ratio(np.maximum(low - 1, 1)), 1e-300), 0.0)
    up, down = np.minimum(up, 1 - 1e-9), np.minimum(down, 1 - 1e-9)
    flat = high - low + 1
    right = np.exp(log_weight(high, c, m) - top) * up / (1 - up)
    left = np.exp(log_weight(low, c, m) - top) * down / (1 - down)
    found, open_ = np.ones(len(c)), np.arange(len(c))
    while len(open_):
        k = live[open_]
        u, v, w = draws.uniform(k), draws.uniform(k), draws.uniform(k)
        u = u * (flat + right + left)[open_]
        f, r = flat[open_], right[open_]
        in_flat, in_right = u < f, (u >= f) & (u < f + r)
        tail = np.where(in_right, up[open_], down[open_])
        step = 1 + np.floor(np.log(v) / np.log(np.clip(tail, 1e-300, 1 - 1e-9)))
        t = np.where(in_flat, low[open_] + np.floor(np.minimum(u, f * (1 - 1e-15)) if len(u) else u), np.where(in_right, high[open_] + step, low[open_] - step))
        inside = (t >= 1) & (t <= c[open_])
        s = np.where(inside, t, 1)
        edge = np.where(in_right, high[open_], low[open_])
        envelope = np.where(in_flat, 0.0, log_weight(edge, c[open_], m[open_]) - top[open_] + step * np.log(np.clip(tail, 1e-300, 1)))
        ok = inside & (np.log(w) <= log_weight(s, c[open_], m[open_]) - top[open_] - envelope)
        found[open_[ok]] = s[ok]
        open_ = open_[~ok]
    out[live] = found.astype(np.int64)
    return out


def log_evidence(strength: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What the log probability of a restaurant's seating owes to its strength."""
    a = strength / DISCOUNT
    return log_gamma(a + tables) - log_gamma(np.full(len(tables), a)) + log_gamma(np.full(len(tables), strength)) - log_gamma(strength + customers)


def drawn(log_weights: np.ndarray, draws: Draws) -> float:
    weights = np.cumsum(np.exp(log_weights - log_weights.max()))
    return float(STRENGTHS[min(int(np.searchsorted(weights, draws.uniform()[0] * weights[-1])), len(STRENGTHS) - 1)])


# ---- the sampler

#: Weights of the root are added up as whole numbers of this part, so that sums don't depend on their order.
PART = 1 << 16


def _mapped(df: DataFrame, schema: str, f) -> DataFrame:
    """df with the columns that f(columns as numpy arrays) returns."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(mapped, schema)


class Sampler:
    """The seating of all restaurants as tables in the shared folder.

    pairs (ctx, word, n) as counted; shared: dishes of two customers or more, with their tables t and the
    sum `own` of their shares in samples; contexts (ctx, c, singles, tables, ...) and words (word, k,
    singles, root_c, ...) with a column lam or p for each sample.  Sweeps leave alone what they can't
    change: contexts without a shared dish, and words with one customer in the root, whose table is certain.
    """

    def __init__(self, pairs: DataFrame, vocabulary: int | None = None, by_context: DataFrame | None = None, by_word: DataFrame | None = None):
        """by_context and by_word: sums over pairs in any parts, as BY_CONTEXT and BY_WORD; with them only pairs of two customers or more are needed."""
        one = F.when(F.col("n") == 1, 1).otherwise(0).cast("long")
        if by_context is None:
            by_context = pairs.select("ctx", F.col("n").alias("c"), one.alias("singles"), F.lit(1).cast("long").alias("tables"))
        if by_word is None:
            by_word = pairs.select("word", F.col("n").alias("k"), one.alias("singles"), F.lit(1).cast("long").alias("root_c"))
        self.shared = cut(pairs.where("n > 1").select("ctx", "word", "n", F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("own")))
        self.all_contexts = cut(by_context.groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("c", "singles", "tables")]))
        self.all_words = cut(by_word.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("k", "singles", "root_c")]))
        self.still_contexts, self.live_contexts = self.all_contexts.where("tables = singles"), self.all_contexts.where("tables > singles")
        self.still_words = self.all_words.where("k = 1").select("word", "k", "singles", "root_c")
        self.live_words = self.all_words.where("k > 1").withColumn("root_t", F.lit(1).cast("long"))
        self.still_alike = cut(self.still_contexts.groupBy("c", "tables").agg(F.count("*").alias("m")))
        size = self.all_words.agg(F.count("*").alias("v"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("k") == 1, 1)), F.lit(0)).alias("still")).first()
        self.vocabulary, self.tokens = int(size.v) if vocabulary is None else vocabulary, int(size.n)
        self.still = int(size.still)
        self.strength, self.root_strength = 1.0, 1.0
        self.strengths: list[float] = []  # of contexts, in each sample
        self.still_shares: list[float] = []  # of each word with one customer, in each sample
        self._totals()

    @property
    def contexts(self) -> DataFrame:
        lams = {f"lam{i + 1}": (s + DISCOUNT * F.col("tables")) / (s + F.col("c")) for i, s in enumerate(self.strengths)}
        return self.live_contexts.unionByName(self.still_contexts.withColumns(lams))

    @property
    def words(self) -> DataFrame:
        shares = {f"p{i + 1}": F.lit(p) for i, p in enumerate(self.still_shares)}
        return self.live_words.drop("root_t").unionByName(self.still_words.withColumns(shares))

    def drop(self) -> None:
        for table in {id(t): t for t in (self.shared, self.all_contexts, self.all_words, self.live_contexts, self.live_words, self.still_alike)}.values():
            drop_table(table)

    def _totals(self) -> None:
        r = self.live_words.agg(F.coalesce(F.sum("root_c"), F.lit(0)).alias("c"), F.coalesce(F.sum("root_t"), F.lit(0)).alias("t")).first()
        self.root_customers, self.root_tables = int(r.c) + self.still, int(r.t) + self.still

    @property
    def base(self) -> float:
        return 1 / (self.vocabulary + 1)

    def unseen(self) -> float:
        """The root's probability of a word without customers."""
        return (self.root_strength + DISCOUNT * self.root_tables) * self.base / (self.root_strength + self.root_customers)

    def _draw_strengths(self, number: int) -> None:
        """Strengths from their conditional distributions over STRENGTHS; whole numbers are added up, in any order."""
        fine = 1 << 10
        schema = ", ".join(f"s{k} long" for k in range(len(STRENGTHS)))
        alike = self.live_contexts.groupBy("c", "tables").agg(F.count("*").alias("m")).unionByName(self.still_alike)  # contexts of few customers are many and alike
        per_context = _mapped(alike, schema, lambda x: {f"s{k}": x["m"] * np.rint(log_evidence(s, x["c"], x["tables"]) * fine).astype(np.int64) for k, s in enumerate(STRENGTHS)})
        sums = per_context.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"s{k}") for k in range(len(STRENGTHS))]).first()
        self.strength = drawn(np.array(sums, np.float64) / fine, Draws(np.array([number]), np.int64(6)))
        at_root = [log_evidence(s, np.array([self.root_customers]), np.array([self.root_tables]))[0] for s in STRENGTHS]
        self.root_strength = drawn(np.array(at_root), Draws(np.array([number]), np.int64(7)))

    def sweep(self, number: int, keep: bool) -> None:
        self._draw_strengths(number)
        base, root_tables, vocabulary = self.base, self.root_tables, self.vocabulary
        strength, root_strength = self.strength, self.root_strength
        # latent weights of the root and masses of the contexts
        whole = (F.col("weight") * PART).cast("long")
        weights = cut(_mapped(self.live_words.select("word", "root_c", "root_t"), "word long, weight double", lambda x: x | {"weight": Draws(x["word"], np.int64(number), np.int64(1)).gamma(x["root_c"] - DISCOUNT * x["root_t"])}))
        still = _mapped(self.still_words.select("word"), "w long", lambda x: {"w": np.array([(Draws(x["word"], np.int64(number), np.int64(1)).gamma(np.full(len(x["word"]), 1 - DISCOUNT)) * PART).astype(np.int64).sum()])})
        sum_of = sum(t.agg(F.coalesce(F.sum(w), F.lit(0)).alias("w")).first().w for t, w in ((weights, whole), (still, F.col("w")))) / PART
        rest = float(Draws(np.array([number]), np.int64(2)).gamma(np.array([root_strength + DISCOUNT * root_tables]))[0])
        root = weights.select("word", ((F.col("weight") + rest / (vocabulary + 1)) / (sum_of + rest)).alias("p"))
        masses = cut(_mapped(self.live_contexts.select("ctx", "c", "tables"), "ctx long, c long, mass double", lambda x: x | {"mass": Draws(x["ctx"], np.int64(number), np.int64(3)).gamma(strength / DISCOUNT + x["tables"])}))

        def seated(x):
            t = tables_of(x["n"], x["mass"] * x["p"], Draws(x["ctx"], x["word"], np.int64(number)))
            own = x["own"] + (x["n"] - DISCOUNT * t) / (strength + x["c"]) if keep else x["own"]
            return x | {"t": t, "own": own}

        dishes = _by_context(self.shared.select("ctx", "word", "n", "own"), masses, ["mass", "c"]).join(root.hint("shuffle_hash"), "word")
        seated_ = cut(_mapped(dishes, "ctx long, word long, n long, t long, own double", seated))
        drop_table(self.shared)
        drop_table(weights)
        drop_table(masses)
        self.shared = seated_
        by_ctx = seated_.groupBy("ctx").agg(F.sum("t").alias("_t"))
        contexts = self.live_contexts.drop("tables").join(by_ctx, "ctx").withColumn("tables", F.col("singles") + F.col("_t")).drop("_t")
        by_word = seated_.groupBy("word").agg(F.sum("t").alias("_t"))
        words = self.live_words.drop("root_c").join(by_word, "word", "left").withColumn("root_c", F.col("singles") + F.coalesce("_t", F.lit(0))).drop("_t")
        mass = float(Draws(np.array([number]), np.int64(4)).gamma(np.array([root_strength / DISCOUNT + root_tables]))[0])
        kept = [c for c in self.live_words.columns if c not in ("root_c", "root_t")]
        schema = ", ".join(f"{c} {'double' if c.startswith('p') else 'long'}" for c in [*kept, "root_c", "root_t"])
        words = cut(_mapped(words, schema, lambda x: x | {"root_t": tables_of(x["root_c"], np.full(len(x["word"]), mass * base), Draws(x["word"], np.int64(number), np.int64(5)))}))
        before = self.live_contexts, self.live_words
        self.live_words = words
        self._totals()
        if keep:
            self.strengths.append(strength)
            contexts = contexts.withColumn(f"lam{len(self.strengths)}", (strength + DISCOUNT * F.col("tables")) / (strength + F.col("c")))
            share = (F.col("root_c") - DISCOUNT * F.col("root_t")) / (root_strength + self.root_customers) + self.unseen()
            self.live_words = words.withColumn(f"p{len(self.strengths)}", share)
            self.still_shares.append((1 - DISCOUNT) / (root_strength + self.root_customers) + self.unseen())
        self.live_contexts = cut(contexts)
        if number > 1:  # the first were parts of the tables of all
            for table in before:
                drop_table(table)


def _by_context(rows: DataFrame, contexts: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns of their context; the rare words' and the start's rows need no shuffle to one key."""
    wide = [signed(RARE), signed(START)]
    known = {r.ctx: r for r in contexts.where(F.col("ctx").isin(wide)).select("ctx", *columns).collect()}  # two rows
    own = F.when(~F.col("ctx").isin(wide), F.col("ctx"))
    joined = rows.withColumn("_own", F.coalesce(own, F.col("word"))).join(contexts.where(~F.col("ctx").isin(wide)).select(F.col("ctx").alias("_own"), *[F.col(c).alias(f"_{c}") for c in columns]).hint("shuffle_hash"), "_own", "left")
    out = [c for c in rows.columns]
    for c in columns:
        value = F.col(f"_{c}")
        for k in wide:
            value = F.when(F.col("ctx") == k, F.lit(known[k][c] if k in known else None)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def sample_model(pairs: DataFrame, vocabulary: int | None = None) -> tuple[Sampler, list[float]]:
    """The sampler after all sweeps, and the averaged root probability of unknown words for each sample."""
    model = Sampler(pairs, vocabulary)
    return model, swept(model)


def swept(model: Sampler) -> list[float]:
    """All sweeps; the root probability of unknown words in each sample."""
    unseen = []
    for number in range(1, BURN_IN + SAMPLES + 1):
        model.sweep(number, number > BURN_IN)
        if number > BURN_IN:
            unseen.append(model.unseen())
    return unseen


def _parent_share(lams, ps):
    """Mean over samples of the context's weight of the root times the root's probability."""
    return sum((a * b for a, b in zip(lams, ps, strict=True)), F.lit(0.0)) / len(ps)


def pair_scores(pairs: DataFrame | None, model: Sampler) -> DataFrame:
    """(pair, n, k, p): for each training pair its count, the word's count and the averaged probability; without pairs, for those met twice or more."""
    lams, ps = [f"lam{s + 1}" for s in range(SAMPLES)], [f"p{s + 1}" for s in range(SAMPLES)]
    rows = model.shared.select("ctx", "word", "n", (F.col("own") / SAMPLES).alias("own"))
    if pairs is not None:
        rows = rows.unionByName(pairs.where("n = 1").select("ctx", "word", "n", F.lit(-1.0).alias("own")))
    rows = _by_context(rows, model.contexts, ["c", *lams]).join(model.words.select("word", "k", *ps).hint("shuffle_hash"), "word")
    single = sum(((1 - DISCOUNT) / (s + F.col("c")) for s in model.strengths), F.lit(0.0)) / SAMPLES
    own = F.when(F.col("n") == 1, single).otherwise(F.col("own"))
    return rows.select(pair_key(F.col("ctx"), F.col("word")).alias("pair"), "n", "k", (own + _parent_share([F.col(x) for x in lams], [F.col(x) for x in ps])).alias("p"))


def pair_key(ctx, word):
    return F.xxhash64(ctx, word)


def pair_keys(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """pair_key of arrays: the 64-bit XXH64 hash of one long after the other, from Spark's seed."""
    # fixed values: the primes of XXH64
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotated(x, n):
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    out = np.empty(len(word), np.uint64)
    for a in range(0, len(word), 16_384):  # a slice stays in the processor's cache
        h = np.uint64(42)
        for x in (ctx[a : a + 16_384], word[a : a + 16_384]):
            h = h + p5 + np.uint64(8)
            h = rotated(h ^ rotated(x * p2, 31) * p1, 27) * p1 + p4
            h = (h ^ h >> np.uint64(33)) * p2
            h = (h ^ h >> np.uint64(29)) * p3
            h ^= h >> np.uint64(32)
        out[a : a + 16_384] = h
    return out


def _least(df: DataFrame, count: str, rows: int) -> int:
    """The least count such that at most so many rows have it or more."""
    by_count = df.groupBy(count).agg(F.count("*").alias("rows"))  # at most about the root of twice the tokens
    upto = by_count.withColumn("upto", F.sum("rows").over(Window.orderBy(F.desc(count))))
    return upto.where(F.col("upto") <= rows).agg(F.min(count)).first()[0] or 1 << 62


class Head:
    """Word counts and scores of the most frequent pairs."""

    def __init__(self, pairs):
        self.pairs, (k, p) = self._sorted(pairs, "pair", ["k", "p"])
        self.log10_k, self.log10_p = np.log10(k + 0.5), np.log10(p)

    @staticmethod
    def _sorted(table, key: str, values: list[str]):
        keys = table.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], [table.column(v).to_numpy()[order] for v in values]

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


def _marks(scored: DataFrame) -> np.ndarray:
    """A bit for each value of the first CONTEXT_BITS bits of a pair's key: unset ones are no pair of the table."""
    place = F.shiftrightunsigned("pair", 64 - CONTEXT_BITS)
    bits = scored.groupBy(F.shiftright(place, 5).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1l, int(shiftrightunsigned(pair, {64 - CONTEXT_BITS}) & 31))")).alias("bits")).toArrow()  # 2^21 rows at most
    marked = np.zeros(1 << (CONTEXT_BITS - 5), np.uint32)
    marked[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return marked


class Frequent:
    """Columns of the frequent contexts and words, found by their hash."""

    def __init__(self, contexts, words):
        self.contexts, self.of_context = Head._sorted(contexts, "ctx", contexts.column_names[1:])
        self.words, self.of_word = Head._sorted(words, "word", words.column_names[1:])

    @classmethod
    def of(cls, model: Sampler) -> Frequent:
        lams, ps = [f"lam{s + 1}" for s in range(SAMPLES)], [f"p{s + 1}" for s in range(SAMPLES)]
        contexts = model.contexts.where(F.col("c") >= _least(model.contexts, "c", HEAD_WORDS)).select("ctx", "c", *lams)
        words = model.words.where(F.col("k") >= _least(model.words, "k", HEAD_WORDS)).select("word", "k", *ps)
        return cls(contexts.toArrow(), words.toArrow())  # HEAD_WORDS rows at most of each


def weak_scores(packed: DataFrame, model: Sampler, shared, unseen: list[float], scale: float) -> DataFrame:
    """(key, _known, _base, _own): sums over the tokens (ctx, word, n, key) whose pair was never met in training or once (n = 0; 1 or -1), the MET_ONCE of packed occurrences, whose table is dropped as soon as it was read.

    What the context and the word tell is found in place for the frequent ones, in a broadcast of Frequent, and by joins for all others.
    """
    import pyarrow as pa

    lams, ps = [f"lam{s + 1}" for s in range(SAMPLES)], [f"p{s + 1}" for s in range(SAMPLES)]
    strengths = list(model.strengths)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held, n = shared.value, [], 0

        def flush():
            key, known, base, own = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, x, len(keys)) for x in (known, base, own)]
            return batch(keys, None, None, None, sums[0].astype(np.int64), *sums[1:])

        def batch(*columns):
            size = len(columns[0])
            kinds = [*[pa.int64()] * 5, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "ctx", "word", "n", "known", "base", "own"])

        for ctx, word, m, key in ((_array(b, x, i, t) for x, t in zip("abcd", PACKED[MET_ONCE].values(), strict=True)) for b in batches for i in range(b.num_rows)):
            u, has_u = Head.find(f.contexts, ctx.view(np.uint64))
            w, has_w = Head.find(f.words, word.view(np.uint64))
            here = has_u & has_w
            rest = np.flatnonzero(~here)
            if len(rest):
                yield batch(key[rest], ctx[rest], word[rest], m[rest], None, None, None)
            here = np.flatnonzero(here)
            if not len(here):
                continue
            u, w = u[here], w[here]
            c, k = f.of_context[0][u], f.of_word[0][w]
            own = sum(((1 - DISCOUNT) / (s + c) for s in strengths), np.zeros(len(c))) / SAMPLES
            p = np.where(m[here] == 0, 0.0, own) + sum((x[u] * y[w] for x, y in zip(f.of_context[1:], f.of_word[1:], strict=True)), np.zeros(len(c))) / SAMPLES
            held.append((key[here], np.ones(len(c)), np.log10(k + 0.5) - scale, np.log10(p)))
            n += len(c)
            if n > HELD_TOKENS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    found = cut(packed.mapInArrow(scored, "key long, ctx long, word long, n long, known long, base double, own double"))
    drop_table(packed)
    rest = _by_context(found.where("ctx is not null").select("key", "ctx", "word", "n"), model.contexts, ["c", *lams]).join(model.words.select("word", "k", *ps).hint("shuffle_hash"), "word", "left")
    single = sum(((1 - DISCOUNT) / (s + F.col("c")) for s in strengths), F.lit(0.0)) / SAMPLES
    parent = _parent_share([F.coalesce(F.col(x), F.lit(1.0)) for x in lams], [F.coalesce(F.col(x), F.lit(u)) for x, u in zip(ps, unseen, strict=True)])
    rest = rest.select("key", F.when(F.col("k") > 0, 1).otherwise(0).cast("long").alias("known"), (F.log10(F.coalesce("k", F.lit(0)) + 0.5) - F.lit(scale)).alias("base"), F.log10(F.when(F.col("n") == 0, 0.0).otherwise(single) + parent).alias("own"))
    both = found.where("ctx is null").select("key", "known", "base", "own").unionByName(rest)
    sums = cut(both.groupBy("key").agg(*[F.sum(c).alias(f"_{c}") for c in ("known", "base", "own")]))
    drop_table(found)
    return sums


def _dealt_scores(scored: DataFrame, scale: float, parts: int) -> DataFrame:
    """(part, pair, base, own) of pairs in arrays: what a token of the pair adds to both scores, dealt by the pair."""
    import pyarrow as pa

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            pair, k, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            pair = pair.view(np.uint64)
            part = pair % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            pair, base, own = pair[order], np.log10(k[order] + 0.5) - scale, np.log10(p[order])
            for i, a, b in _slices(part[order], parts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([_bytes(x[a:b])], pa.binary()) for x in (pair, base, own))], names=["part", "pair", "base", "own"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("pair", "k", "p")])
            n += b.num_rows
            if n > HELD_TOKENS:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    return scored.select("pair", "k", "p").mapInArrow(dealt, "part int, pair binary, base binary, own binary")


def _sums_of_pairs(asked: DataFrame, scored: DataFrame, scale: float) -> DataFrame:
    """(row, _known, _base, _own): sums over the pairs that rows ask for, (part, pair, at, times, rows) in arrays, of those in scored.

    Both are dealt by the pair; what is found goes back to the rows, also in arrays.
    """
    import pyarrow as pa

    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["part", "rows", "known", "base", "own"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = [], []
        for b in batches:
            for i in range(b.num_rows):
                if b.column("rows")[i].is_valid:
                    wanted.append([b.column(c)[i].as_buffer() for c in ("pair", "at", "times", "rows")])
                else:
                    table.append([_array(b, "pair", i, np.uint64), _array(b, "base", i, np.float64), _array(b, "own", i, np.float64)])
        if not table:
            return
        keys, base, own = (np.concatenate(x) for x in zip(*table, strict=True))
        order = np.argsort(keys)
        keys, base, own = keys[order], base[order], own[order]
        for pair, at, times, rows in wanted:
            place, hit = Head.find(keys, np.frombuffer(pair, np.uint64))
            doc, row = _large(at, rows)
            place, doc, times = place[hit], doc[hit], np.frombuffer(times, np.int32)[hit].astype(np.float64)
            if len(place):
                sums = [np.bincount(doc, x, len(row)) for x in (times, times * base[place], times * own[place])]
                # a row is in one block of texts, and so are all rows that were sent with it
                yield pa.RecordBatch.from_arrays([pa.array([int(mix(row[:1].view(np.uint64) >> np.uint64(33))[0] % np.uint64(parts))], pa.int32()), *(pa.array([_bytes(x)], pa.binary()) for x in (row, sums[0].astype(np.int64), *sums[1:]))], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[_array(b, c, i, t) for c, t in zip(names[1:], (np.int64, np.int64, np.float64, np.float64), strict=True)] for b in batches for i in range(b.num_rows)]
        if held:
            row, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            row, at = np.unique(row, return_inverse=True)
            known, base, own = (np.bincount(at, x, len(row)) for x in values)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own)], names=["row", "_known", "_base", "_own"])

    both = asked.unionByName(_dealt_scores(scored, scale, parts), allowMissingColumns=True)
    sent = both.repartitionById(parts, F.col("part")).mapInArrow(found, "part int, rows binary, known binary, base binary, own binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(summed, "row long, _known long, _base double, _own double")


def score_documents(docs: DataFrame, context_customers: int = CONTEXT_CUSTOMERS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    with shuffles_freed(docs.sparkSession):
        return _score_documents(docs, context_customers)


def _score_documents(docs: DataFrame, context_customers: int) -> DataFrame:
    import pyarrow as pa

    spark = docs.sparkSession
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _folded(docs)
    # a word of the training rows that no customer sits at predicts as the root does, so all words may be marked
    own_contexts = Contexts() if context_customers <= 1 else Contexts.of_counts(word_counts(rows), context_customers)
    contexts = spark.sparkContext.broadcast(own_contexts)  # 8 MB at most
    met = packed_turns(rows, contexts)
    twice, by_context, by_word = (reduce(DataFrame.unionByName, [unpacked(turn[kind], kind) for turn in met]) for kind in (MET_TWICE, BY_CONTEXT, BY_WORD))
    model = Sampler(twice, by_context=by_context, by_word=by_word)
    for turn in met:
        for kind in (MET_TWICE, BY_CONTEXT, BY_WORD):
            drop_table(turn[kind])
    unseen = swept(model)
    size, train_tokens = model.vocabulary, model.tokens
    scale = float(np.log10(train_tokens + 0.5 * (size + 1)))
    # pairs that training rows hold once, or never, are scored where they were counted
    known = spark.sparkContext.broadcast(Frequent.of(model))
    weak = []
    for turn in met:
        weak.append(weak_scores(turn[MET_ONCE], model, known, unseen, scale))
    known.destroy()  # each executor holds a file of it
    # the others with their probability; the frequent ones go to the texts
    scored = cut(pair_scores(None, model))
    model.drop()
    least_pair = _least(scored, "n", HEAD_PAIRS)
    frequent = scored.where(F.col("n") >= least_pair).select("pair", "k", "p")
    shared = spark.sparkContext.broadcast((Head(frequent.toArrow()), _marks(scored)))  # HEAD_PAIRS rows at most, and 8 MB

    doc_names = ["doc_id", "held_out", "key", "row", "n_tokens", "known", "base", "own"]
    pair_names = ["part", "pair", "at", "times", "rows"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, marked = shared.value
        held, rows_of, n = [], [], 0

        def flush():
            keys, doc, times = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own = np.concatenate(rows_of)
            part = keys % np.uint64(n_parts)
            order = np.argsort(part, kind="stable")
            keys, doc, times = keys[order], doc[order], times[order]
            for p, a, b in _slices(part[order], n_parts):
                at, few = _small(doc[a:b], own)
                blobs = [pa.array([x], pa.binary()) for x in (_bytes(keys[a:b]), at, _bytes(times[a:b]), few)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in doc_types), pa.array([p], pa.int32()), *blobs], names=[*doc_names, *pair_names])

        doc_types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in in_blocks(batches, BLOCK_BYTES):
            all_toks, lengths = block_tokens(b.column("text"))
            ends = np.cumsum(lengths)
            starts = ends - lengths  # each text has a token, its end
            all_keys = pair_keys(contexts.value.of(all_toks, starts), all_toks)
            at, hit = head.find(head.pairs, all_keys)
            base, own = np.zeros(len(all_toks)), np.zeros(len(all_toks))
            base[hit] = head.log10_k[at[hit]] - scale
            own[hit] = head.log10_p[at[hit]]
            place = all_keys >> np.uint64(64 - CONTEXT_BITS)
            open_ = np.flatnonzero(~hit & (marked[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0))
            # distinct pairs of each text, text after text
            keys, doc = all_keys[open_], np.repeat(np.arange(len(lengths)), lengths)[open_]
            order = np.argsort(keys)
            order = order[np.argsort(doc[order].astype(np.uint16) if len(lengths) <= 1 << 16 else doc[order], kind="stable")]
            keys, doc = keys[order], doc[order]
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])][: len(keys)])
            held.append((keys[first], doc[first].astype(np.int64) + sum(map(len, rows_of)), np.diff(np.r_[first, len(keys)]).astype(np.int32)))
            rows_of.append(b.column("row").to_numpy())
            n += len(first)
            sums = [pa.array(lengths), pa.array(np.add.reduceat(hit.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "key", "row")), *sums, pa.nulls(b.num_rows, pa.int32()), *[pa.nulls(b.num_rows, pa.binary())] * 4], names=[*doc_names, *pair_names])
            if n > HELD_TOKENS:
                yield from flush()
                rows_of, n = [], 0
        if n:
            yield from flush()

    schema = "doc_id long, held_out boolean, key long, row long, n_tokens long, known long, base double, own double, part int, pair binary, at binary, times binary, rows binary"
    both = cut(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, schema))
    parts = both.where("part is null").select(*doc_names)
    # what isn't met was scored as a weak token
    sums = cut(_sums_of_pairs(both.where("part is not null").select(*pair_names), scored.where(F.col("n") < least_pair), scale))
    # weak tokens of equal held-out texts were added up: each has its share
    copies = parts.groupBy("key").agg(F.count("*").alias("copies"))
    weak = reduce(DataFrame.unionByName, weak).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("_known", "_base", "_own")]).join(copies, "key")
    weak = weak.select("key", (F.col("_known") / F.col("copies")).cast("long").alias("_weak_known"), *[(F.col(f"_{c}") / F.col("copies")).alias(f"_weak_{c}") for c in ("base", "own")])
    zero = F.lit(0.0)
    return parts.join(sums, "row", "left").join(weak, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0)) + F.coalesce("_weak_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero) + F.coalesce("_weak_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("_own", zero) + F.coalesce("_weak_own", zero)).alias("score"),
    )
