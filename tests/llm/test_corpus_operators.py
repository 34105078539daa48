"""Jaccard join, line dedup, language model, pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import op7_jaccard_join as J
from framelake.llm import op8_line_dedup as L
from framelake.llm import op10_lm_scoring as H
from framelake.llm.common import numbered, read

from .conftest import WORDS, odd_documents, words


def test_numbered_is_gapless(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50) for i in range(200)], "g int, v int").repartition(5)
    rows = numbered(df, "v", within="g").collect()
    for g in range(3):
        own = sorted((r.row_no, r.v) for r in rows if r.g == g)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r.row_no for r in numbered(df, "v").collect()) == list(range(200))


# ---- Jaccard join


def brute_join(docs):
    """{(doc_id, text): (class_id, class_size, links, group_id)}"""
    ids = {}
    for i, t in docs:
        ids.setdefault(t or "", []).append(i)
    texts = list(ids)
    sets = [set(J.shingle_set(t).tolist()) for t in texts]
    least = [min((i for i in ids[t] if i is not None), default=None) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    group = {}
    for k, r in enumerate(root):
        group.setdefault(r, []).append(least[k])
    return {(i, t): (least[k], len(ids[t]), links[k], min((x for x in group[root[k]] if x is not None), default=None)) for k, t in enumerate(texts) for i in ids[t]}


def near_copies(seed, n):
    r = random.Random(seed)
    docs = []
    for c in range(8):
        base = words(r, 150).split()
        for k in range(n if c == 0 else 5):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            docs.append((len(docs), " ".join(w)))
    return docs + [(1000 + i, words(r, 100)) for i in range(40)] + [(2000, docs[0][1]), (2001, docs[0][1])]


@pytest.mark.parametrize("block", [512, 7])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)  # small blocks split the large band into many tasks
    docs = near_copies(5, 60)
    got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute_join(docs)
    text = dict(docs)
    assert {r.doc_id: (r.class_id, r.class_size, r.links, r.group_id) for r in got} == {i: want[i, text[i]] for i in text}
    assert sum(r.links for r in got) > 500


def test_join_of_odd_rows(spark, odd, none, clashing):
    docs = [(i, t) for i, t, *_ in odd_documents()]
    want = brute_join(docs)
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.links, r.group_id) for r in J.near_duplicates(clashing).collect()), key=str)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in docs), key=str)
    kept = J.one_of_each_group(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len({v[3] if v[3] is not None else k for k, v in want.items()})
    assert J.near_duplicates(none).count() == 0 and J.one_of_each_group(none).count() == 0


def test_groups_of_null_and_equal_ids_stay_apart(spark):
    r = random.Random(8)
    alone = [words(r, 60) for _ in range(5)]
    base = words(r, 100)
    near = base + " more"
    shared = [words(r, 60) for _ in range(3)]
    docs = [(None, t) for t in [*alone, alone[0], base, near]] + [(7, t) for t in shared]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = J.one_of_each_group(df).collect()
    texts = [k.text for k in kept]
    assert sorted(t for t in texts if t not in (base, near)) == sorted(alone + shared)
    assert len([t for t in texts if t in (base, near)]) == 1
    found = J.near_duplicates(df).collect()
    assert len({bytes(f.root) for f in found}) == 9 and {f.group_id for f in found} == {None, 7}


def test_dense_and_single_verification_agree(monkeypatch):
    sets = [J.shingle_set(t) for _, t in near_copies(6, 20)][:40]
    pairs = np.array([(a, b) for a in range(40) for b in range(a + 1, 40)])
    monkeypatch.setattr(J, "COLUMNS", 100)
    dense = J.verified(sets, pairs[:, 0], pairs[:, 1])
    monkeypatch.setattr(J, "DENSE_PAIRS", 10**9)
    assert (dense == J.verified(sets, pairs[:, 0], pairs[:, 1])).all() and dense.any()


def test_posterior_limits():
    limits = J.least_agreements()
    assert list(limits) == sorted(limits)
    n, p = 64, 0.8  # a pair at the threshold is dropped at this step about never
    below = sum(math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(limits[n // J.STEP - 1]))
    assert below < 1e-5


# ---- line dedup


def brute_lines(docs, least):
    lines = [(t or "").split("\n") for _, t in docs]
    out = []
    for a, own in enumerate(lines):
        gone, size = set(), [len(x.split()) for x in own]
        for i in range(len(own)):
            best = 0
            for b in range(a + 1):
                for j in range(len(lines[b]) if b < a else i):
                    n = 0
                    while i + n < len(own) and j + n < len(lines[b]) and own[i + n] == lines[b][j + n]:
                        n += 1
                    best = max(best, n)
            if best and sum(size[i : i + best]) >= least:
                gone |= set(range(i, i + best))
        out.append((docs[a][0], len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    r = random.Random(7)
    docs = [(k, "\n".join(r.choice(["a b", "c", "d e f", "g h i j", "k", ""]) for _ in range(r.randint(0, 14)))) for k in range(60)]
    docs = sorted([*docs, docs[5], (99, docs[5][1]), (100, None)], key=lambda d: d[0])
    got = L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 8)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(docs, 8)


def test_lines_of_odd_rows(spark, none, clashing):
    got = L.without_repeats(clashing).collect()
    assert len(got) == len(odd_documents())
    assert sorted(r.n_removed for r in got if r.doc_id == 3) == [0, 1, 1] and all(r.text == "" for r in got if r.n_removed)
    assert L.without_repeats(none).count() == 0


def test_ranks_are_a_suffix_array(spark):
    r = random.Random(9)
    docs = [(k, "\n".join(r.choice("abcd") for _ in range(r.randint(1, 9)))) for k in range(40)]
    lines, rows = L._lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    start = {x.doc_id: x.d for x in rows.collect()}
    assert [start[k] for k in range(40)] == list(np.cumsum([0, *[len(t.split("\n")) + 1 for _, t in docs]])[:-1])
    line = {start[k] + n: x for k, t in docs for n, x in enumerate(t.split("\n"))}
    place = {bytes(x.h): x.p for x in lines.collect()}
    assert len(place) == 4
    order = {line[p]: h for h, p in place.items()}  # the order among lines is that of their hashes
    active, rounds = L._rounds(lines, 0)
    for k, ranks in enumerate(rounds):
        got = {x.p: x["rank"] for x in ranks.collect()}
        run = {p: tuple(order[line[p + i]] for i in range(1 << k)) for p in line if all(p + i in line for i in range(1 << k))}
        repeated = sorted({v for v in run.values() if sum(w == v for w in run.values()) > 1})
        assert got == {p: repeated.index(v) for p, v in run.items() if v in repeated}
    assert len(rounds) >= 2


def test_line_ids_have_independent_halves(spark):
    got = spark.range(5000).select(L.line_id(F.col("id").cast("string")).alias("h")).collect()
    halves = np.array([np.frombuffer(bytes(x.h), np.uint64) for x in got])
    assert len(set(halves[:, 0])) == len(set(halves[:, 1])) == 5000
    # no bit of one half follows a bit of the other
    bits = np.unpackbits(halves.view(np.uint8), axis=1).astype(float)
    assert np.abs(np.corrcoef(bits.T)[:64, 64:]).max() < 0.08


def test_lines_of_many_rows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 7)
    r = random.Random(11)
    docs = [(k, "\n".join(r.choice(["a b c", "d e", "f"]) for _ in range(r.randint(0, 8)))) for k in range(30)]
    got = L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 5)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(docs, 5)


# ---- language model


def contract(docs):
    toks = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in docs]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (i, _), t, h in zip(docs, toks, held, strict=True)]


@pytest.mark.parametrize("head", [(65_536, 10**6), (20, 15), (0, 0)])
def test_lm_contract_columns(spark, clashing, monkeypatch, head):
    monkeypatch.setattr(H, "HEAD_WORDS", head[0])  # few or no tokens scored without the join
    monkeypatch.setattr(H, "HEAD_PAIRS", head[1])
    got = H.score_documents(clashing, 3).collect()
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(rows, key=str) == sorted(contract([(i, t) for i, t, *_ in odd_documents()]), key=str)
    assert all(r.score <= 0 for r in got)


def test_lm_scores_do_not_depend_on_how_rows_are_dealt(spark, odd, monkeypatch):
    def scored(df, head):
        monkeypatch.setattr(H, "HEAD_PAIRS", head)
        return sorted((str(r.doc_id), r.score) for r in H.score_documents(df, 3).collect())

    plain = scored(odd, 10**6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = scored(odd.repartition(7), 30)
        # logarithms are added up in another order, so the last digits may differ
        assert [i for i, _ in again] == [i for i, _ in plain]
        assert max(abs(a - b) / max(1, abs(b)) for (_, a), (_, b) in zip(again, plain, strict=True)) < 1e-12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lm_beats_the_base_on_held_out_rows(spark):
    got = [r for r in H.score_documents(read(spark, "/root/testdata/sf0.001", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_gains_from_the_whole_tree_at_the_registered_setting(spark):
    assert H.CONTEXT_CUSTOMERS == 1
    got = [r for r in H.score_documents(read(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.5


def test_lm_joins_only_pairs_met_twice(spark, odd, monkeypatch):
    joined, pair_scores = [], H.pair_scores
    monkeypatch.setattr(H, "pair_scores", lambda *a: joined.append(pair_scores(*a)) or joined[-1])
    monkeypatch.setattr(H, "drop_table", lambda table: None)
    assert H.score_documents(odd).count() == odd.count()
    assert joined[0].agg(F.min("n")).first()[0] > 1  # most pairs occur once: they are scored where they were counted


@pytest.mark.parametrize("tokens", [1_000_000, 5])
def test_lm_occurrences(spark, monkeypatch, tokens):
    monkeypatch.setattr(H, "HELD_TOKENS", tokens)
    r = random.Random(8)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randrange(12)))) for i in range(60)] + [(500 + i, "alpha1 beta2 alpha1 beta2 new") for i in range(12)]
    rows = H._folded(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).cache()
    got = Counter()
    for turn in H.all_occurrences(rows, spark.sparkContext.broadcast(H.Contexts())):
        got.update((x.ctx, x.word, x.n, x.key) for x in turn.collect())
    tokens_of = [(x.held_out, x.key, [int(t) for t in H.tokens(x.text).view(np.int64)]) for x in rows.collect()]
    pairs = [(h, k, p) for h, k, t in tokens_of for p in zip([H.signed(H.START), *t[:-1]], t, strict=True)]
    n = Counter(p for h, _, p in pairs if not h)
    want = Counter({(*p, m, 0 if m > 1 else next(k for h, k, q in pairs if q == p and not h)): 1 for p, m in n.items()})
    want.update((*p, -n[p], k) for h, k, p in pairs if h and n[p] < 2)
    assert got == want and {x[2] for x in want} >= {-1, 0, 1, 2}


def test_lm_of_copies_on_both_sides(spark):
    texts = ["a b c d e f g", "only once here", "a b once more", "", None]
    docs = [(i, texts[i % 5]) for i in range(7)] + [(i, texts[k]) for k in range(5) for i in range(10 + 40 * k, 50 + 40 * k) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = H.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(contract(docs))
    text_of = {i: t or "" for i, t in docs}
    assert len({(text_of[r.doc_id], round(r.score, 9)) for r in got}) == len({t or "" for t in texts})


def test_pair_keys_are_those_of_spark(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "ctx long, word long")
    got = df.select("*", H.pair_key(F.col("ctx"), F.col("word")).alias("k")).collect()
    ctx, word = (np.array([r[i] for r in got]).view(np.uint64) for i in (0, 1))
    assert H.pair_keys(ctx, word).view(np.int64).tolist() == [r.k for r in got]


def sampled(spark, docs, customers):
    rows = H._folded(docs)
    counts = H.word_counts(rows)
    contexts = spark.sparkContext.broadcast(H.Contexts.of_counts(counts, customers))
    pairs = H.cut(H.pair_counts(rows, contexts))
    model, unseen = H.sample_model(pairs, counts.count())
    return model, unseen, pairs


def test_lm_predictions_sum_to_one(spark):
    model, unseen, pairs = sampled(spark, read(spark, "/root/testdata/sf0.001", "documents").limit(40), 10)
    lam = {r.ctx: [r.lam1, r.lam2] for r in model.contexts.collect()}
    words = {r.word: [r.p1, r.p2] for r in model.words.collect()}
    assert len(lam) > 30 and abs(sum(p[0] for p in words.values()) + unseen[0] - 1) < 1e-9
    total = dict.fromkeys(lam, 0.0)
    of_pair = {r.pair: r.p for r in H.pair_scores(pairs, model).collect()}
    own = pairs.select("ctx", "word", H.pair_key(F.col("ctx"), F.col("word")).alias("pair")).collect()
    for c in list(lam)[:30]:
        seen = {r.word: of_pair[r.pair] for r in own if r.ctx == c}
        rest = sum(np.mean(np.multiply(lam[c], p)) for w, p in words.items() if w not in seen) + np.mean(np.multiply(lam[c], unseen))
        total[c] = sum(seen.values()) + rest
        assert abs(total[c] - 1) < 1e-9


def test_lm_of_no_rows(spark, none):
    assert H.score_documents(none).count() == 0


def test_table_counts_follow_their_distribution():
    def stirling(c, d=0.5):  # weights of seating c customers at t tables, by adding one customer after another
        row = [1.0]
        for n in range(1, c):
            row = [(row[t - 1] * (n - d * t) if t <= len(row) else 0.0) + (row[t - 2] if t >= 2 else 0.0) for t in range(1, n + 2)]
        return np.array(row)

    n = 40_000
    for c, mass in [(2, 0.3), (3, 5.0), (7, 0.01), (12, 2.0), (12, 300.0), (60, 9.0)]:
        want = stirling(c) * (mass * 0.5) ** np.arange(1, c + 1)
        want /= want.sum()
        t = H.tables_of(np.full(n, c), np.full(n, mass), H.Draws(np.arange(n), np.int64(c)))
        got = np.bincount(t, minlength=c + 1)[1:] / n
        assert np.abs(got - want).max() < 5 * np.sqrt(0.25 / n), (c, mass)
    huge = H.tables_of(np.full(1000, 10**9), np.full(1000, 40.0), H.Draws(np.arange(1000)))
    assert abs(huge.mean() - 40.5) < 1.5  # far from c, t - 1 is a Poisson number of that mean, near enough
    g = H.Draws(np.arange(n), np.int64(9)).gamma(np.full(n, 0.5))
    assert abs(g.mean() - 0.5) < 0.02 and abs(g.var() - 0.5) < 0.05


def plain_gibbs(pairs, vocabulary, sweeps, burn_in, seed):
    """Averaged P(w | u) of seen pairs, with every customer taken away and seated again, one at a time."""
    rng = np.random.default_rng(seed)
    d = 0.5

    class Restaurant:
        def __init__(self, parent):
            self.parent, self.sizes, self.c, self.t = parent, {}, 0, 0

        def p(self, w):
            base = self.parent.p(w) if self.parent else 1 / (vocabulary + 1)
            own = self.sizes.get(w, [])
            return (sum(own) - d * len(own) + (1.0 + d * self.t) * base) / (1.0 + self.c)

        def add(self, w):
            own = self.sizes.setdefault(w, [])
            base = self.parent.p(w) if self.parent else 1 / (vocabulary + 1)
            weights = np.array([s - d for s in own] + [(1.0 + d * self.t) * base])
            k = rng.choice(len(weights), p=weights / weights.sum())
            self.c += 1
            if k < len(own):
                own[k] += 1
            else:
                own.append(1)
                self.t += 1
                if self.parent:
                    self.parent.add(w)

        def remove(self, w):
            own = self.sizes[w]
            k = rng.choice(len(own), p=np.array(own) / sum(own))
            own[k] -= 1
            self.c -= 1
            if not own[k]:
                own.pop(k)
                self.t -= 1
                if self.parent:
                    self.parent.remove(w)

    root = Restaurant(None)
    rooms = {u: Restaurant(root) for u, _ in pairs}
    customers = [k for k, n in pairs.items() for _ in range(n)]
    for u, w in customers:
        rooms[u].add(w)
    total = dict.fromkeys(pairs, 0.0)
    for sweep in range(sweeps):
        for u, w in customers:
            rooms[u].remove(w)
            rooms[u].add(w)
        if sweep >= burn_in:
            for u, w in pairs:
                total[u, w] += rooms[u].p(w) / (sweeps - burn_in)
    return total


def test_lm_matches_a_plain_sampler(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLES", 12)
    monkeypatch.setattr(H, "STRENGTHS", np.ones(1))  # as in the plain sampler
    texts = ["a b a b a b c", "a c a c d", "b a b a d d", "c a b", "a b c a b c a b", "d d d a"]
    docs = [(i, t) for i, t in enumerate(texts * 2) if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = Counter()
    for _, t in docs:
        own = [*t.split(), "\n"]
        pairs.update(zip(["", *own[:-1]], own, strict=True))
    want = plain_gibbs(dict(pairs), len({w for _, w in pairs}), 260, 30, 4)
    got = {r.doc_id: r.score for r in H.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()}
    for i, t in docs:
        own = [*t.split(), "\n"]
        expected = sum(math.log10(want[p]) for p in zip(["", *own[:-1]], own, strict=True))
        assert abs(got[i] - expected) < 0.06 * len(own) ** 0.5, (i, got[i], expected)
    assert abs(sum(got.values()) - sum(sum(math.log10(want[p]) for p in zip(["", *[*t.split()]], [*t.split(), "\n"], strict=True)) for _, t in docs)) < 0.5


# ---- pipeline


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = J.cut(out)
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "decontamination":
            from framelake.llm.op4_decontamination import leaks

            assert leaks(docs, read(spark, d, "benchmark")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_words_of_lines(spark):
    r = random.Random(8)
    lines = ["", " ", "one", "one two", " one", "one ", "a  b", "\t", "a\tb", "a \x0bb\x0cc\rd", "ä\u00a0b ö\u2003", "\x1c x"]
    lines += ["".join(r.choice("ab  \t\x0b\x0c\rä\u00a0") for _ in range(r.randrange(12))) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", L.words_in(F.col("line")).alias("n")).collect()
    assert [(x.line, x.n) for x in got] == [(x, len(re.findall(r"[^ \t\n\x0b\f\r]+", x))) for x in lines]
