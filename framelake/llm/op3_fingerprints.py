"""Document fingerprints: Order MinHash over words.

A text's k-mers are runs of three words, each numbered by its occurrence.  For each of 64
hash functions the two k-mers of least hash are selected, kept in text order, and the ordered
pair is hashed to one entry of the signature.  The share of equal entries estimates a
likeness that falls with edit distance, as moved text changes the order of pairs.

Fingerprints of a row and its neighbour need both texts.  Rows are dealt out once by ranges
of (doc_id, text hash); the first row of each range is also sent to the range before it, so no
range needs another one's text and no window runs over the whole table.  A doc_id that many
rows share is split by the hash; only rows equal in both id and text stay together.

Defined results: a null text is empty; the fingerprint of a text without words is its own
value, equal only to that of other such texts; with fewer than three words the whole is one
k-mer, with one k-mer it is selected alone; rows that tie in doc_id follow the hash of their
text; a single row is its own next; a very long text is
fingerprinted whole, by one task at a time; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, mix, shingle_hashes, text_or_empty, word_hashes

ENTRIES = 64
KMER_WORDS = 3
#: Values in a block of the hash matrix; bounds memory for long texts.
BLOCK = 2_000_000
_A = mix(np.arange(1, ENTRIES + 1, dtype=np.uint64)) | np.uint64(1)


def numbered_kmers(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash joined with the number of its earlier occurrences."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return mix(kmers)
    at = np.arange(len(s))
    seen = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(kmers)
    out[order] = mix(s + mix(seen.astype(np.uint64)) * (seen > 0))
    return mix(out)


def order_minhash(words: np.ndarray) -> np.ndarray:
    """The signature of a text given as word hashes."""
    kmers = shingle_hashes(words, KMER_WORDS)
    n = len(kmers)
    if not n:
        return np.zeros(ENTRIES, np.uint32)
    x = numbered_kmers(kmers)
    x32 = (x >> np.uint64(32)).astype(np.uint32)
    first, second = np.empty(ENTRIES, np.int64), np.empty(ENTRIES, np.int64)
    step = max(1, BLOCK // n)
    a32 = (_A >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    for i in range(0, ENTRIES, step):
        h = a32[i : i + step, None] * x32[None, :]
        first[i : i + step] = at = h.argmin(1)
        if n > 1:
            h[np.arange(len(at)), at] = np.uint32(0xFFFFFFFF)
            second[i : i + step] = h.argmin(1)
    if n > 1:
        first, second = np.minimum(first, second), np.maximum(first, second)
        out = mix(mix(x[first]) + mix(x[second] ^ np.uint64(0x5BD1E995)) * np.uint64(3))
    else:
        out = mix(x[first])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never 0, which stands for no words


def fingerprint(text: str) -> np.ndarray:
    return order_minhash(word_hashes(text.split()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    import pyarrow as pa

    names_ = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types_ = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # bounds between ranges: as many values as partitions, and parts of ids that fill several of them
    size = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("b"), F.count("*").alias("n")).first()
    hot = rows.groupBy("id").count().where(F.col("count") * parts > size.n).collect()  # fewer ids than partitions
    least = -(1 << 63)
    between = {(i, least) for i in size.b or []}
    for r in hot:
        split = -(-r["count"] * parts // size.n)
        between |= {(r.id, least + (k << 64) // split) for k in range(split)}
    bound_ids, bound_ties = (np.array([b[k] for b in sorted(between)], np.int64) for k in (0, 1))

    def places(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The range of each row: how many bounds are not behind it."""
        out = np.searchsorted(bound_ids, ids, side="left")
        last = np.searchsorted(bound_ids, ids, side="right")
        for i in np.unique(ids[last > out]):
            mine = ids == i
            a, z = np.searchsorted(bound_ids, i, side="left"), np.searchsorted(bound_ids, i, side="right")
            out[mine] = a + np.searchsorted(bound_ties[a:z], ties[mine], side="right")
        return out

    @F.pandas_udf("int")
    def range_of(ids, ties):
        import pandas as pd

        return pd.Series(places(ids.to_numpy(), ties.to_numpy()), dtype="int32")

    ranges = rows.select("id", "tie").withColumn("part", range_of("id", "tie")).groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")).orderBy("part").collect()
    # the first row of a range goes to the range before it too; that of the first range to the last
    copies = {(r.first.id, r.first.tie): ranges[i - 1].part for i, r in enumerate(ranges)}

    @F.pandas_udf("array<int>")
    def targets_of(ids, ties):
        import pandas as pd

        own = places(ids.to_numpy(), ties.to_numpy()).tolist()
        before = [copies.get(x) for x in zip(ids.tolist(), ties.tolist(), strict=True)]
        return pd.Series([[a] if b is None else [a, b] for a, b in zip(own, before, strict=True)])

    dealt = (
        rows.select("*", F.posexplode(targets_of("id", "tie")).alias("is_copy", "to"))
        .repartitionById(max(parts, len(bound_ids) + 1), F.col("to"))
        .sortWithinPartitions("to", "is_copy", "id", "tie")
        .select("to", "is_copy", "doc_id", "text")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ended = None, None  # (range, doc_id, text, signature) of the row that waits for its next
        for b in in_blocks(batches):
            out = []
            for to, is_copy, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_copy and ended == to:
                    continue  # a repeated first row
                own = fingerprint(text)
                if before and before[0] == to:
                    _, its_id, its_text, its = before
                    edited = edited_text(its_text, text)
                    changed = fingerprint(edited)
                    out.append((its_id, len(its_text), hashlib.sha256(edited.encode()).hexdigest(), its.astype(">u4").tobytes().hex(), changed.astype(">u4").tobytes().hex(), likeness(its, changed), likeness(its, own)))
                before, ended = (None, to) if is_copy else ((to, doc_id, text, own), None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types_, strict=True)], names=names_)

    return dealt.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
