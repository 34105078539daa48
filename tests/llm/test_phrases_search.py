"""Phrase mining and ranked search against plain versions, on small and odd tables."""

import math
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import op12_phrases as P
from framelake.llm import op13_search as S

from .conftest import SCHEMA

# ---- phrases


def lowered(text):
    return (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))


def plain_phrases(rows, least, longest=4, most=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    held = Counter()
    for (lang, p), (_, a, _, _) in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                held[lang, p[i : i + size]] = max(held[lang, p[i : i + size]], a)
    kept = {}
    for (lang, p), v in found.items():
        if 100 * held[lang, p] < 80 * v[1]:
            kept.setdefault(lang, []).append((-v[0], -v[1], " ".join(p).encode(), v))
    out = []
    for lang, rows in kept.items():
        for rank, (_, _, phrase, (score, a, left, right)) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, total[lang], score))
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in P.mine_phrases(docs, **options).collect())


@pytest.fixture(scope="module")
def prose(spark):
    r = random.Random(5)
    few = "a b c d É f-g".split()
    rows = [(i, r.choice([" ", "\t ", "  "]).join(r.choice(few) for _ in range(r.randrange(1, 30))) + r.choice([".", ",\n", " ", "!"]) * 2 + "Hot Pair HOT pair here", r.choice(["en", "de", None, "und"])) for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, " \t ", "en"), (903, "x y " * 5000, "fr"), (903, "x y " * 5000, "fr")]
    return rows


@pytest.mark.parametrize("least", [2, 7, 30])
def test_phrases_equal_a_plain_count(spark, prose, least):
    docs = spark.createDataFrame(prose, "doc_id long, text string, lang string").repartition(3)
    assert mined(docs, least=least) == plain_phrases([(t, lang) for _, t, lang in prose], least)


def test_full_bit_table_and_small_blocks_lose_nothing(spark, prose, monkeypatch):
    docs = spark.createDataFrame(prose, "doc_id long, text string, lang string")
    want = plain_phrases([(t, lang) for _, t, lang in prose], 5, most=4)
    monkeypatch.setattr(P, "FILTER_BITS", 64)
    monkeypatch.setattr(P, "BLOCK_BYTES", 300)
    monkeypatch.setattr(P, "RANK_PARTS", 3)
    # workers import the module anew; what they are given is the table itself, so its length decides there
    monkeypatch.setattr(P, "frequent_bits", lambda counts: np.full(P.FILTER_BITS >> 6, np.uint64(2**64 - 1)).repeat(1 << 20))
    assert mined(docs, least=5, most=4) == want


def test_block_phrases_pass_a_filter():
    import pyarrow as pa

    table = np.zeros(P.FILTER_BITS >> 6, np.uint64)
    for word in ("a", "b"):
        bit = P._bit(f"en\0{word}".encode())
        table[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
    texts, langs = pa.array(["a b c a b", "a b", "b"]), pa.array(["en", "en", "en"])
    got = {p: int(n) for _, phrases, sums in P.block_phrases(langs, texts, np.array([1, 10, 5]), (2, 4), {1: table}) for p, n in zip(phrases.to_pylist(), sums, strict=True)}
    assert got == {"a b": 12}


def test_bits_are_those_of_the_engine(spark):
    counts = spark.createDataFrame([("en", "a b", 3), ("und", "é", 1)], "lang string, phrase string, n long")
    table = P.frequent_bits(counts)
    set_bits = {int(w) * 64 + b for w in np.flatnonzero(table) for b in range(64) if int(table[w]) >> b & 1}
    assert set_bits == {P._bit("en\0a b".encode()), P._bit("und\0é".encode())}


def test_products_beyond_64_bits(spark):
    n = 1 << 60
    found = spark.createDataFrame([("en", "a b", n), ("en", "a", n + 12345), ("en", "b", 2 * n)], "lang string, phrase string, n long")
    row = P.weakest_cuts(found).first()
    assert row.score == 2_000_000 * n // (3 * n + 12345) and int(Decimal(row.l)) == n + 12345
    longer = found.unionByName(spark.createDataFrame([("en", "a b c", n * 8 // 10 + 1), ("en", "c", n), ("en", "b c", n)], found.schema))
    assert {r.phrase for r in P.not_contained(P.weakest_cuts(longer)).collect()} == {"a b c", "b c"} - ({"b c"} if 100 * (n * 8 // 10 + 1) >= 80 * n else set())


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_phrases_of_odd_tables(request, kind):
    docs = request.getfixturevalue(kind)
    assert mined(docs, least=2) == plain_phrases([(d.text, d.lang) for d in docs.collect()], 2)


# ---- search


def plain_terms(text):
    return [t.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, most=10):
    rows = [(i, plain_terms(t)) for i, t in docs]
    rows = [(i, Counter(w), len(w)) for i, w in rows if w]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, w, _ in rows for t in w)
    out = []
    for item, text in items:
        found = []
        for doc_id, w, n in rows:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w[t]) // (1000 * w[t] + 8 * m)) for t in set(plain_terms(text)) if t in w)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


def searched(docs, items, **options):
    return sorted((tuple(r) for r in S.search_documents(docs, items, **options).collect()), key=str)


ITEMS = [(1, "alpha7 beta3 gamma"), (2, "ALPHA7, other!"), (3, None), (4, "..."), (4, "x zeta9 zeta9"), (None, "ünï çöde İ one 😀"), (7, "nowheretobefound"), (8, "x " * 500)]


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_search_of_odd_tables(spark, request, kind):
    docs = request.getfixturevalue(kind)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(5))
    assert searched(docs, items) == plain_search([(d.doc_id, d.text) for d in docs.collect()], ITEMS)


def test_items_in_several_blocks_and_an_empty_table_of_items(spark, odd, monkeypatch):
    want = plain_search([(d.doc_id, d.text) for d in odd.collect()], ITEMS, most=3)
    monkeypatch.setattr(S, "ITEM_BYTES", 30)
    assert searched(odd, spark.createDataFrame(ITEMS, "item_id long, text string"), most=3) == want
    assert searched(odd, spark.createDataFrame([], "item_id long, text string")) == []


def test_ties_in_many_shards(spark):
    r = random.Random(8)
    kinds = ["a b c", "a b", "b c d", "a", "c d e a"]
    rows = [(k, r.choice(kinds)) for k in range(20_000)]
    r.shuffle(rows)
    items = [(1, "a b"), (2, "c"), (3, "e d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string")) == plain_search(rows, items)


def least_overstatement(values, longest, cost):
    best = [0]
    for i in range(1, len(values) + 1):
        best.append(min(best[j] + (i - j) * max(values[j:i]) + cost for j in range(max(0, i - longest), i)))
    return best[-1]


def test_blocks_overstate_least():
    r = np.random.default_rng(3)
    lists = [r.integers(1, 100, n) for n in (1, 2, 7, 40, 100)] + [np.full(50, 9), np.zeros(0, np.int64)]
    values = np.concatenate(lists)
    sizes = np.array([len(v) for v in lists])
    starts = np.cumsum(sizes) - sizes
    ends = S.block_ends(values, starts, sizes, longest=8, cost=2)
    for v, a, n in zip(lists, starts, sizes, strict=True):
        if not n:
            continue
        own = np.flatnonzero(ends[a : a + n]) + 1
        assert own[-1] == n
        cost = int(2 * v.sum() / n)
        total = sum((b - a0) * v[a0:b].max() + cost for a0, b in zip([0, *own[:-1]], own, strict=True))
        assert total == least_overstatement(v.tolist(), 8, cost) and np.diff([0, *own]).max() <= 8


def test_blocks_skip_documents_and_keep_the_best():
    r = np.random.default_rng(4)
    n_docs, n_terms = 4000, 30
    own = [np.sort(r.choice(n_terms, r.integers(1, 8), replace=False)) for _ in range(n_docs)]
    pointers = np.r_[0, np.cumsum([len(o) for o in own])]
    flat = np.concatenate(own)
    values = (r.pareto(1.2, len(flat)) * 100).astype(np.int64) + 1
    shard = S.Shard(list(range(n_docs)), pointers, flat, values, n_terms)
    asked = np.zeros(n_terms, bool)
    wanted = np.array([1, 5, 9])
    asked[wanted] = True
    whole = shard.scores(np.arange(n_docs), asked)
    assert (shard.bounds(wanted) >= whole).all()
    best = S.Best(10)
    scored = S.search_shard(shard, wanted, asked, best)
    want = sorted(((-int(s), d) for d, s in enumerate(whole) if s > 0))[:10]
    assert [(-s, d) for s, d in best.rows] == want
    assert scored < n_docs / 3


def test_schema_of_both(spark, none):
    assert P.mine_phrases(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(S.search_documents(empty, spark.createDataFrame([], "item_id long, text string")).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
