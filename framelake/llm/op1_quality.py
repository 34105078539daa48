"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words, of its repeated words (one vector for
a word that follows itself, one with a word between) and of the character 3- to 5-grams of
its words (with the blanks around a word as its marks), each hashed into one of 2^17 rows.  A
softmax over a linear layer gives class probabilities.  numpy stochastic gradient descent
trains vectors and layer together, one text a step.

The classifier is fitted on a bounded sample, MAX_TRAIN labelled texts (whole texts, chosen
by a hash of doc_id); every whole text is scored.  As the layer is linear, each row's vector
is folded into one number after training, so a score is a mean of table look-ups.

Labels are read only from rows whose crc32(doc_id as text) mod 4 is not 2.  Labels, language,
source and doc_id never enter a score.  Defined results: null and empty texts have no
features and get the score of the layer's bias alone; several labels of one doc_id count as
their majority, a tie as 0; null labels are ignored; without labels of both classes every
score is 0.5 and `accepted` keeps all rows, as nothing was learnt; a very long text is averaged like
others, whole; texts with equal features tie in score; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, text_or_empty, word_hashes

BUCKET_BITS = 17
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
#: Labelled texts that the classifier is fitted on, and how.
MAX_TRAIN = 4000
EPOCHS = 6
RATE = 0.4
SEED = 5
#: A text is accepted from this score.
ACCEPT = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2


def features(text: str) -> np.ndarray:
    """A row number for each word and each n-gram of a text."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (codes > 32) & (codes != 160)
    words = word_hashes(text.split())
    out = [(words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    # word bigrams by pattern only: a word that stands one or two places earlier too
    out += [np.full(int((words[d:] == words[:-d]).sum()), (1 << BUCKET_BITS) - d, np.int64) for d in (1, 2)]
    n = len(codes)
    h = codes * np.uint32(0x9E3779B1)
    valid = np.ones(n, bool)
    for k in range(2, max(NGRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[k - 1 :]
        valid = valid[:m] & inside[k - 2 : k - 2 + m] if k > 2 else valid[:m]
        if k in NGRAMS:
            g = h[valid] * np.uint32(0xC2B2AE35)
            out.append((g >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out)


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], seed: int = SEED) -> tuple[np.ndarray, float]:
    """(rows, counts, label) of each text -> the logit that each row adds, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rows, counts, label = texts[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ table[rows]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * error
            # a row moves by its share of the text, scaled up as texts have hundreds of features
            table[rows] -= (rate * min(50, len(rows))) * share[:, None] * back[None, :]
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Train on at most max_train labelled texts outside the held-out fold."""
    import pyarrow as pa

    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("mean"))
        .select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)  # the sample the classifier is fitted on
    )
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            out = [np.unique(features(t), return_counts=True) for t in b.column("text").to_pylist()]
            # row numbers ascend, so their differences pack well; the driver unpacks them
            rows = pa.array([zlib.compress(np.diff(r, prepend=0).astype(np.int32).tobytes(), 1) for r, _ in out], pa.binary())
            counts = pa.array([zlib.compress(c.astype(np.int32).tobytes(), 1) for _, c in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), rows, counts], names=["doc_id", "label", "rows", "counts"])

    def unpacked(data) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), np.int32)

    found = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(counted, "doc_id long, label int, rows binary, counts binary").collect()
    texts = [(np.cumsum(unpacked(r.rows), dtype=np.int32), unpacked(r.counts), r.label) for r in sorted(found, key=lambda r: r.doc_id)]
    if len({t[2] for t in texts}) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return train(texts)


def scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for whole texts."""
    z = np.full(len(texts), bias)
    for i, t in enumerate(texts):
        f = features(t or "")
        if len(f):
            z[i] += float(table[f].mean(dtype=np.float64))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; a narrow scan."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^17 numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches):
            s = scores(b.column("text").to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def fitted(model: tuple[np.ndarray, float]) -> bool:
    """Whether the model has learnt from labels of both classes; fit returns zeros otherwise."""
    table, bias = model
    return bool(bias or table.any())


def accepted(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; all rows if no model could be fitted."""
    if not fitted(model):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_blocks(batches):
            yield b.filter(pa.array(scores(b.column(at).to_pylist(), *shared.value) >= ACCEPT))

    return docs.mapInArrow(kept, docs.schema)
