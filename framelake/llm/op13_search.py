"""Ranked lexical search: variable-block-max WAND over shards of posting lists.

1. A scan reduces each document to its length and the counts of the terms that items ask for; the
   result is written as a table, from which the number of documents, their terms and each term's
   documents are counted.
2. Each task reads that table in shards of a bounded number of documents, in which it inverts the
   rows to posting lists with the exact contribution of each posting.  Every list is cut into
   blocks of variable length by dynamic programming: the cut minimises what the blocks' largest
   contributions overstate, plus a fixed cost for each block.
3. An item's blocks add up to a bound for every place of the shard.  The search jumps from one
   pivot, a document whose bound reaches the item's tenth best score so far, to the next, scores pivots
   exactly and raises the threshold, which a task keeps from shard to shard.  A bound that equals the
   threshold is looked at, so ties are exact.
4. The best of each task are ranked together.

No posting is shuffled and shards need no order, so skewed terms or sources make no hot task.
Items are taken in blocks of bounded text; each block scans the documents once.

Defined results: null and empty texts have no terms and are never found; an item without terms
finds nothing; very long texts are documents like others; rows that repeat are documents each;
equal scores go by ascending doc_id, a null one first; rows of one item_id are items each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_blocks

BEST = 10
#: Fixed values of the score: length share, saturation and scale.
LENGTH_SHARE, UNIT = 90, 1_000_000_000
#: Text of the items of a block in bytes; longer items are blocks of their own.
ITEM_BYTES = 4 << 20
#: Documents and postings of a shard (the row that passes a bound is the last).
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Postings in a block at most, and what a block costs in mean contributions of its list.
LONGEST_BLOCK, BLOCK_COST = 32, 2
#: Documents whose bounds are looked at together, at first and at most.
FIRST_STEP, LAST_STEP = 32, 1024

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # in lower-cased UTF-8: letters and digits of ASCII, and all else above


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().lower()) if text else []  # bytes: A-Z only are lower-cased


def profiles(docs: DataFrame, vocabulary: dict[bytes, int], text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n (all terms), terms, counts (of the vocabulary's) for each document with a term."""
    import pyarrow as pa

    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one block of items

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value.get
        for b in in_blocks(batches):
            ids, sizes, ends, own, counts = [], [], [0], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                met = Counter(map(number, found))
                met.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(found))
                own.extend(met.keys())
                counts.extend(met.values())
                ends.append(len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((own, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(reduced, "doc_id long, n long, terms array<int>, counts array<long>")


def block_ends(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int = LONGEST_BLOCK, cost: float = BLOCK_COST) -> np.ndarray:
    """Whether a block ends behind each posting, for all lists (values from starts, so many) at once.

    best[i], the least sum over blocks of length x largest value + cost that covers the first i
    postings of a list, is the least of best[j] + (i - j) x max(j..i) + cost; the sum of the values
    themselves doesn't depend on the cut.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    ends, back = np.zeros(len(values), bool), np.zeros(len(values), np.int32)
    totals = np.r_[0, np.cumsum(values)]
    own_cost = (cost * (totals[starts + sizes] - totals[starts]) / np.maximum(sizes, 1)).astype(np.int64)[:, None]
    width = np.arange(1, longest + 1)
    far = np.int64(1) << 60
    best = np.full((len(starts), longest), far)  # of the prefixes that end 1, 2, ... postings back
    best[:, 0] = 0
    largest = np.zeros((len(starts), longest), np.int64)
    active = len(starts)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        while active and sizes[active - 1] <= i:
            active -= 1
        at = starts[:active] + i
        v = values[at][:, None]
        largest[:active, 1:] = np.maximum(largest[:active, :-1], v)
        largest[:active, 0] = v[:, 0]
        reach = best[:active] + largest[:active] * width
        taken = reach.argmin(axis=1)
        back[at] = taken + 1
        best[:active, 1:] = best[:active, :-1]
        best[:active, 0] = reach[np.arange(active), taken] + own_cost[:active, 0]
    left = sizes.copy()
    rows = np.flatnonzero(left > 0)
    while len(rows):
        at = starts[rows] + left[rows] - 1
        ends[at] = True
        left[rows] -= back[at]
        rows = rows[left[rows] > 0]
    return ends


class Shard:
    """Posting lists of a few documents: contributions, blocks, and the rows for exact scores."""

    def __init__(self, doc_ids: list, pointers: np.ndarray, own: np.ndarray, values: np.ndarray, n_terms: int):
        self.doc_ids, self.pointers, self.own, self.values = doc_ids, pointers, own, values
        doc = np.repeat(np.arange(len(doc_ids)), np.diff(pointers))
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=n_terms)
        starts = np.cumsum(sizes) - sizes
        listed, places = values[order], doc[order]
        ends = np.flatnonzero(block_ends(listed, starts, sizes))
        begins = np.r_[0, ends[:-1] + 1]
        self.first, self.behind = places[begins], places[ends] + 1
        self.most = np.maximum.reduceat(listed, begins) if len(listed) else listed
        self.blocks = np.searchsorted(ends, np.r_[starts, len(listed)])  # of a term: blocks[t] up to blocks[t + 1]

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """For each document the sum of the largest contributions of the blocks of the terms that span it."""
        b = np.concatenate([np.arange(self.blocks[t], self.blocks[t + 1]) for t in wanted])
        steps = np.zeros(len(self.doc_ids) + 1, np.int64)
        np.add.at(steps, self.first[b], self.most[b])
        np.subtract.at(steps, self.behind[b], self.most[b])
        return np.cumsum(steps)[:-1]

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        sizes = self.pointers[docs + 1] - self.pointers[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.pointers[docs] - (ends - sizes), sizes)
        return np.add.reduceat(np.where(asked[self.own[at]], self.values[at], 0), ends - sizes)


class Best:
    """The best documents of an item so far."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    @property
    def threshold(self) -> int:
        """What a document must reach: the last score of a full list, else 1."""
        return self.rows[-1][0] if len(self.rows) == self.most else 1

    def add(self, rows: Iterator[tuple]) -> None:
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[: self.most]


def search_shard(shard: Shard, wanted: np.ndarray, asked: np.ndarray, best: Best) -> int:
    """Adds the shard's documents that belong to the best; gives the number of documents scored."""
    bounds, at, step, scored = shard.bounds(wanted), 0, FIRST_STEP, 0
    while at < len(bounds):
        pivots = at + np.flatnonzero(bounds[at : at + step] >= best.threshold)
        if len(pivots):
            found = shard.scores(pivots, asked)
            scored += len(pivots)
            good = np.flatnonzero(found >= best.threshold)
            best.add((int(found[g]), shard.doc_ids[pivots[g]]) for g in good)
        at, step = at + step, min(2 * step, LAST_STEP)
    return scored


def best_of_shards(table: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray, items: list[np.ndarray], most: int) -> DataFrame:
    """(item_no, doc_id, score): the best documents of each task for each item."""
    import pyarrow as pa

    held = table.sparkSession.sparkContext.broadcast((weights, items))  # of one block of items

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = held.value
        wanted = [np.array([t for t in i if weights[t] > 0], np.int64) for i in items]
        best = [Best(most) for _ in items]
        rows, postings = [], 0

        def search() -> None:
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
            pointers = np.r_[0, np.cumsum([len(r[2]) for r in rows])]
            own, tf = (np.concatenate([r[c] for r in rows]).astype(np.int64) for c in (2, 3))
            m = np.repeat([100 - LENGTH_SHARE + LENGTH_SHARE * r[1] * n_docs // n_terms for r in rows], np.diff(pointers))
            values = weights[own] * ((UNIT * tf) // (1000 * tf + 8 * m))
            shard = Shard([r[0] for r in rows], pointers, own, values, len(weights))
            asked = np.zeros(len(weights), bool)
            for mine, found in zip(wanted, best, strict=True):
                if len(mine):
                    asked[mine] = True
                    search_shard(shard, mine, asked, found)
                    asked[mine] = False

        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            ends = b.column(2).offsets.to_numpy()
            own, tf = (b.column(c).values.to_numpy() for c in (2, 3))
            for k, doc_id in enumerate(ids):
                if ends[k + 1] > ends[k]:
                    rows.append((doc_id, sizes[k], own[ends[k] : ends[k + 1]], tf[ends[k] : ends[k + 1]]))
                    postings += int(ends[k + 1] - ends[k])
                if len(rows) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    search()
                    rows, postings = [], 0
        if rows:
            search()
        out = [(i, d, s) for i, found in enumerate(best) for s, d in found.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item_no", "doc_id", "score"])

    return table.mapInArrow(searched, "item_no int, doc_id long, score long")


def _item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.select(F.col(id_column).alias("i"), F.col(text_column).cast("string").alias("t")).toLocalIterator():
        n = len((r.t or "").encode())
        if block and size + n > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


def term_weights(table: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, weight of each term of the vocabulary) of a table of profiles."""
    total = table.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holders = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a term of the block at most
    weights = np.zeros(n_terms, np.int64)
    for r in holders:
        weights[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    return total.docs, total.terms, weights


def search_documents(docs: DataFrame, items: DataFrame, most: int = BEST, text_column: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0."""
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _item_blocks(items, item_id, item_text):
        vocabulary: dict[bytes, int] = {}
        asked = [np.unique([vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)]).astype(np.int64) for _, text in block]
        if not vocabulary:
            continue
        table = cut(profiles(docs, vocabulary, text_column, id_column))
        n_docs, n_terms, weights = term_weights(table, len(vocabulary))
        if not n_docs:
            continue
        found = best_of_shards(table, n_docs, n_terms, weights, asked, most)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), "doc_id")
        first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item_no int, item_id {id_type}")
        out = out.unionByName(first.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score"))
    return out
