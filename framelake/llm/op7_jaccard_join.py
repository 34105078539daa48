"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Rows of equal texts form a class (a 128-bit hash of the text); everything after works on one
row a class.  A class has the set of its five-word shingles and 128 MinHash values of 16 bits.

1. Candidates share one of 32 bands of four values.  A pair at similarity 0.8 misses them all
   with probability 5e-8.
2. Bands are split into tasks of two blocks of about BLOCK members, so a band of any size is
   many small tasks and no task gathers a whole group.  In a task, a pair counts only if the
   task's band is the first that it shares.  MinHash values are compared 16 at a time; after
   each step the posterior of the similarity (uniform prior) given the agreements so far says
   how probable 0.8 or more still is, and pairs below TOLERANCE are dropped.
3. What survives is verified exactly on shingle sets.  A task keeps, for each member, the list
   of partners: rows grow with members, not with pairs.

Links join classes into groups (connected components by repeated star contraction; tables
are written in between).

Defined results: a null text counts as empty; texts without words are linked to nothing; a
text of fewer than five words is one shingle; the class id is the smallest doc_id of the
class (null if all are null); rows that share a doc_id are told apart by their texts, and groups
by their root, so that neither null nor equal ids merge them; very long texts are compared whole; an empty table gives no rows; extra columns are kept by `one_of_each_group`, ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR, cut, drop_table, grouped, in_blocks, mix, shingle_hashes, text_key, text_or_empty, word_hashes

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
BLOCK = 512
#: From so many pairs on, a task is verified by a matrix product instead of one pair after another.
DENSE_PAIRS = 64
#: Shingles (columns) and members (rows) of the matrix at once.
COLUMNS = 4096
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)).astype(np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text.split()))) if text else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values, the low 16 bits of each, as 32 bands of 64 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        h = _A[:, None] * x[None, i : i + 4096] + _B[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(low, (h * np.uint32(0x2C1B3C6D)).min(1), out=low)
    return low.astype(np.uint16).view(np.int64)


@cache
def least_agreements(near: float = NEAR, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After 16, 32, ... compared values: the fewest agreements at which similarity `near` is still probable enough.

    With a uniform prior, m agreements of n leave a Beta(m+1, n-m+1) posterior; its upper tail
    at `near` is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0  # P(similarity >= near | m of n) = P(Binomial(n + 1, near) <= m)
        for m in range(n + 1):
            tail += comb(n + 1, m) * near**m * (1 - near) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
        else:
            out.append(n + 1)
    return tuple(out)


def surviving_pairs(bands: np.ndarray, band: int, block: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a task that share no earlier band and aren't pruned."""
    n = len(bands)
    left, right = [], []
    limits = least_agreements()
    values = bands.view(np.uint16).reshape(n, HASHES)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if cross:
            j = j[block[i + 1 :] != block[i]]
        j = j[bands[j, band] == bands[i, band]]
        if band:
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
        agreed = np.zeros(len(j), np.int64)
        for k, least in enumerate(limits):
            if not len(j):
                break
            at = slice(k * STEP, (k + 1) * STEP)
            agreed = agreed + (values[j, at] == values[i, at]).sum(1)
            kept = agreed >= least
            j, agreed = j[kept], agreed[kept]
        left.append(np.full(len(j), i))
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, near: float = NEAR) -> np.ndarray:
    """Which pairs have at least the similarity, by exact set sizes."""
    size = np.array([len(s) for s in sets])
    if len(left) < DENSE_PAIRS:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    else:
        keys, at = np.unique(np.concatenate(sets), return_inverse=True)
        who = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(at, minlength=len(keys)) > 1  # others are in no intersection
        column = np.cumsum(often) - 1
        who, at = who[often[at]], column[at[often[at]]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(often.sum()), COLUMNS):
            a, b = np.searchsorted(at, [c, c + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[who[a:b], at[a:b] - c] = 1
            total += m @ m.T
        common = total[left, right].astype(np.int64)
    union = size[left] + size[right] - common
    return (common > 0) & (common >= near * union - 1e-9)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) for each row, and (key, class_id, class_size, bands) for each class."""
    import pyarrow as pa

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            bands = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_or_empty().alias("text"))
    rows = cut(rows.mapInArrow(signed, "doc_id long, key binary, bands array<long>"))
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.first("bands").alias("bands"))
    return rows.select("doc_id", "key"), cut(classes)


def _survivors(classes: DataFrame) -> DataFrame:
    """(task, key, id, partners): members of tasks that are in a surviving pair; partners are ids of members listed later."""
    import pyarrow as pa

    keys = classes.where("bands is not null").select("key", F.posexplode("bands").alias("band", "value"))
    keys = keys.select("key", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("key", "band", "block", (F.col("blocks") > 1).alias("many"), (F.col("other") != F.col("block")).alias("cross"), F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    rows = tasks.join(classes.select("key", "bands"), "key").repartition("task").sortWithinPartitions("task", "key")

    def pruned(batches: Iterator) -> Iterator:
        out: list[tuple] = []
        for task, pdf in grouped(batches, "task"):
            bands = np.array(pdf["bands"].tolist(), np.int64).reshape(len(pdf), BANDS)
            i, j = surviving_pairs(bands, int(pdf["band"].iloc[0]), pdf["block"].to_numpy(), bool(pdf["cross"].iloc[0]))
            if len(i):
                keys = pdf["key"].tolist()
                ids = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)
                bounds = np.searchsorted(i, np.arange(len(pdf) + 1))
                for m in sorted({*i.tolist(), *j.tolist()}):
                    out.append((task, keys[m], int(ids[m]), ids[j[bounds[m] : bounds[m + 1]]].tolist()))
            if len(out) > 5000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return rows.mapInPandas(pruned, "task long, key binary, id long, partners array<long>")


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["task", "key", "id", "partners"])


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, links, root): verified links of a class in a task, and the least key of its component there."""
    import pandas as pd

    survivors = cut(_survivors(classes))
    involved = survivors.select("key").distinct().join(classes.select("key", "class_id"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), text_or_empty().alias("text")).withColumn("key", text_key())
    # one row of each class: the one whose doc_id is the class id
    texts = texts.join(involved.withColumnRenamed("key", "k").withColumnRenamed("class_id", "c"), (F.col("key") == F.col("k")) & F.col("class_id").eqNullSafe(F.col("c"))).select("key", "text").dropDuplicates(["key"])
    rows = survivors.join(texts, "key").repartition("task").sortWithinPartitions("task", "key")

    def checked(batches: Iterator) -> Iterator:
        out: list[tuple] = []
        for _, pdf in grouped(batches, "task"):
            keys = pdf["key"].tolist()
            at = {d: n for n, d in enumerate(pdf["id"].tolist())}
            pairs = [(n, at[p]) for n, partners in enumerate(pdf["partners"]) for p in partners]
            left, right = np.array(pairs, np.int64).reshape(-1, 2).T
            ok = verified([shingle_set(t) for t in pdf["text"]], left, right)
            left, right = left[ok], right[ok]
            links = np.bincount(np.r_[left, right], minlength=len(keys))
            root = np.arange(len(keys))
            while True:
                new = root.copy()
                np.minimum.at(new, left, root[right])
                np.minimum.at(new, right, root[left])
                if (new == root).all():
                    break
                root = new
            out += [(keys[n], int(links[n]), keys[root[n]]) for n in np.flatnonzero(links)]
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["key", "links", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "links", "root"])

    return cut(rows.mapInPandas(checked, "key binary, links long, root binary"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the least key of each key's connected component, by large-star and small-star steps."""

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # large star: each neighbour above u points to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut(large)
        # small star: u and its neighbours below point to the least of them
        low = least(large)
        small = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(large)
        drop_table(edges)
        edges = small
        if new == state:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        state = new


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_size, links, group_id, root for each row of docs.

    links counts the other classes (different texts) at similarity 0.8 or more; group_id is the
    smallest class id of the connected component; root, its least key, names the component also
    where group_id is null or components share it.
    """
    rows, classes = _classes(docs)
    links = _links(docs, classes)
    roots = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    count = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "class_id", "class_size").join(count, "key", "left").join(roots, "key", "left")
    known = cut(known.withColumn("root", F.coalesce("root", "key")).withColumn("links", F.coalesce("links", F.lit(0).cast("long"))))
    groups = known.groupBy("root").agg(F.min("class_id").alias("group_id"))
    known = known.join(groups, "root")
    return rows.join(known, "key").select("doc_id", "key", "class_id", "class_size", "links", "group_id", "root")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id (then of the least text hash)."""
    found = near_duplicates(docs)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("class_id"), F.col("key"))).alias("best"))
    kept = best.select(F.col("best.class_id").alias("_keep_id"), F.col("best.key").alias("_keep_key"))
    # the row travels as one struct, so that no column of docs can clash with the operator's
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
    joined = rows.join(kept, (F.col("_key") == F.col("_keep_key")) & F.col("_id").eqNullSafe(F.col("_keep_id")))
    return joined.dropDuplicates(["_keep_key", "_keep_id"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
