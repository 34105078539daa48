"""How op10 deals pairs: a context's rows lie in an eighth of the partitions, and no context fills one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import op10_lm_scoring as H


@pytest.mark.parametrize("turn", range(H.TURNS))
def test_rows_of_a_context_lie_together(spark, turn):
    r = random.Random(5)
    texts = [[f"w{r.randrange(40)}" for _ in range(300)] for _ in range(30)]
    rows = H._folded(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        found = H.occurrences(rows, spark.sparkContext.broadcast(H.Contexts()), turn).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    at = {}
    for f in found:
        at.setdefault(f.ctx, set()).add(f.part)
    assert len(at) == 41 and max(map(len, at.values())) <= 2  # dealt by pair alone, about 12 of 16
    # all training pairs of the turn are there with their counts
    training = [f.text.split() for f in rows.where("not held_out").collect()]
    want = Counter()
    for t in training:
        toks = H.tokens(" ".join(t))
        ctx = H.Contexts().of(toks)
        here = (H.pair_keys(ctx, toks) >> np.uint64(32)) % np.uint64(H.TURNS) == turn
        want.update(zip(ctx[here].view(np.int64).tolist(), toks[here].view(np.int64).tolist(), strict=True))
    assert {(f.ctx, f.word): f.n for f in found if f.n > 0} == want


@pytest.mark.parametrize("parts", [1, 7, 12, 64, 512])
def test_a_frequent_context_fills_no_partition(parts):
    r = np.random.default_rng(3)
    n = 400_000
    ctx = r.integers(0, 1 << 63, n).astype(np.uint64)
    ctx[: n // 20] = 77  # a twentieth of all pairs
    word = r.integers(0, 1 << 63, n).astype(np.uint64)
    sizes = np.bincount(H.part_of(ctx, H.pair_keys(ctx, word), parts).astype(np.int64), minlength=parts)
    assert len(sizes) == parts and sizes.max() < 2 * n / parts


def test_tokens_of_a_block_are_those_of_its_texts():
    r = random.Random(4)
    texts = ["", None, " ", "A\x00b a\x00 a", "a\vb\fc\rd", "\x1f\x85\xa0 é É", *("X" * n for n in range(1, 70))] + ["".join(r.choice("aB \n\t\x00é€") for _ in range(r.randrange(40))) for _ in range(500)]
    toks, lengths = H.block_tokens(pa.array(["not this one", *texts]).slice(1))
    of_word, at = {}, 0
    for t, n in zip(texts, lengths.tolist(), strict=True):
        own, at = toks[at : at + n], at + n
        words = [*(t or "").encode().lower().split(), b"\n"]
        assert len(words) == n and own.tolist() == H.tokens(t).tolist()
        assert all(of_word.setdefault(w, h) == h for w, h in zip(words, own.tolist(), strict=True))
    assert len(set(of_word.values())) == len(of_word)


def test_shuffle_files_go_with_their_query(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with H.shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
