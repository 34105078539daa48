"""Replay, deferred verdicts, versions, levels, palettes and fits against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import blocks as K
from framelake.operators import graphs as G
from framelake.operators import metrics as M
from framelake.operators import replay as P


def plain_replay(rows):
    out = {}
    for stream in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == stream), key=lambda r: r[1])
        points = sorted({tu for _, _, tu, kind, _, _ in own if kind == "point"})
        for _, n, tu, kind, key, leading in own:
            if kind != "refer":
                continue
            for a in points:
                if a > tu or (tu > a and leading):
                    continue
                sent = [s for s in own if s[3] == "send" and s[4] == key and s[1] < n and (s[2] == a or (s[2] > a and not s[5]))]
                if not sent and (stream, key, a) not in out:
                    out[stream, key, a] = n
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_a_plain_one(spark, seed):
    r = random.Random(seed)
    rows = []
    for stream in range(3):
        tu, n = 0, 0
        for _ in range(25):
            leading = r.random() < 0.3
            for _ in range(r.randrange(1, 6)):
                rows.append((stream, n, tu, r.choice(["point", "send", "refer", "refer", "other"]), r.randrange(3), leading))
                n += 1
            tu += 1
    df = spark.createDataFrame(rows, "stream int, n int, tu int, kind string, key int, leading boolean").repartition(5)
    got = P.replay_findings(df)
    assert sorted(tuple(x) for x in got.collect()) == plain_replay(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_verdicts_settled_far_away(spark):
    rows = [(1, 0, "open", 0), (1, 10_000, "settle", 7), (1, 10_001, "open", 0), (1, 10_002, "open", 0), (1, 10_003, "settle", 8), (1, 10_004, "settle", 9), (2, 5, "open", 0)]
    df = spark.createDataFrame(rows, "s int, n int, kind string, v int").repartition(6)
    got = P.settled_later(df, ["s"], "n", F.col("kind") == "open", F.col("kind") == "settle", "v").orderBy("s", "n").collect()
    assert [(r.s, r.n, r.settled_at, r.settled_by) for r in got] == [(1, 0, 10_000, 7), (1, 10_001, None, None), (1, 10_002, 10_003, 8), (2, 5, None, None)]


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_versions_that_overlap(spark, bucket):
    r = random.Random(bucket)
    sides = [[(k, p, f"v{r.randrange(3)}") for k in range(4) for p in sorted(r.sample(range(100), 8))] for _ in range(2)]
    valid = [P.versions(spark.createDataFrame(s, "id int, from int, what string"), ["id"], "from", F.lit(100)) for s in sides]
    got = sorted((x.id, x.l_from, x.r_from, x.since) for x in P.overlaps(*valid, keys=["id"], bucket=bucket).collect())
    ends = [{(k, a): min([b for j, b, _ in s if j == k and b > a], default=100) for k, a, _ in s} for s in sides]
    want = sorted((k, a, b, max(a, b)) for (k, a), u in ends[0].items() for (j, b), v in ends[1].items() if j == k and a < v and b < u)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_versions_in_force_with_ties_and_nulls(spark, seed):
    r = random.Random(seed)
    rows = [(k, own, p, f"{own}{p}") for k in (0, 1, 2, None) for own in (True, False, None) for p in [*(r.randrange(12) for _ in range(7)), None]]
    df = spark.createDataFrame(rows, "id int, own boolean, from long, what string").repartition(5)
    got = P.in_force(P.versions(df.dropna(), ["id", "own"], "from", F.lit(10**15)), ["id"], "own")
    sides = {(k, own): sorted(p for i, o, p, _ in rows if (i, o) == (k, own) and p is not None) for k in range(3) for own in (True, False)}
    valid = {side: list(zip(at, [*at[1:], 10**15])) for side, at in sides.items()}
    want = sorted((k, a, b, f"True{a}", f"False{b}", max(a, b)) for k in range(3) for a, u in valid[k, True] for b, v in valid[k, False] if a < v and b < u)
    assert sorted((x.id, x.l_from, x.r_from, x.l_what, x.r_what, x.since) for x in got.collect()) == want
    assert any(a == u for at in valid.values() for a, u in at)


def plain_levels(nodes, edges):
    level, left = {}, set(nodes)
    needs = {n: {s for s, d in edges if d == n and s in left} for n in nodes}
    rank = 0
    while ready := {n for n in left if needs[n] <= level.keys()}:
        level |= dict.fromkeys(ready, rank)
        left -= ready
        rank += 1
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("back", [0, 3])
def test_levels_of_random_graphs(spark, back):
    r = random.Random(back)
    want, nodes, edges = {}, [], []
    for g in range(3):
        own = [(a, b) for b in range(25) for a in r.sample(range(25), 2) if a < b] + [tuple(r.sample(range(25), 2)) for _ in range(back)] + [(99, 1), (1, 1)][: 1 + bool(back)]
        nodes += [(g, n) for n in range(25)]
        edges += [(g, a, b) for a, b in [*own, *own[:3]]]
        want |= {(g, n): lv for n, lv in plain_levels(range(25), set(own)).items()}
    got = G.levels(spark.createDataFrame(nodes, "graph int, node int"), spark.createDataFrame(edges, "graph int, src int, dst int"), ["graph"])
    assert {(x.graph, x.node): x.level for x in got.collect()} == want
    if back:
        assert None in want.values()


def plain_palette(samples, size):
    counts = Counter(samples)
    runs = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    if len(runs) <= size:
        colours = sorted(v for v, _ in runs)
        return colours if len(colours) >= 2 else None
    seeds = sorted(v for v, _ in runs[:size])
    groups = {s: [] for s in seeds}
    for x in samples:
        groups[min(seeds, key=lambda s: (abs(s - x), s))].append(x)
    moved = [(sum(g) + len(g) // 2) // len(g) if 2 * g.count(s) < len(g) else s for s, g in groups.items()]
    colours = sorted(set(moved))
    return colours if len(colours) >= 2 else None


def test_palettes(spark):
    r = random.Random(9)
    blocks = [[r.randrange(top) + r.randrange(1 + top // 3) for _ in range(64)] for top in (1, 2, 3, 6, 9, 30, 200)] + [[5] * 64, [1] * 32 + [2] * 32, [0] + [255] * 63]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "k int, x array<int>")
    for size in (2, 4, 8):
        got = {x.k: x.p and list(x.p) for x in df.select("k", K.palette(F.col("x"), size).alias("p")).collect()}
        assert got == {k: plain_palette(b, size) for k, b in enumerate(blocks)}


def test_cubic_fit_equals_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(x), float(np.sin(3 * x) + r.normal() / 10)) for k in range(3) for x in r.uniform(-1, 1, 50)] + [(9, 1.0, 1.0), (9, 2.0, 2.0)]
    got = {x.k: x for x in M.polynomials(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    for k in range(3):
        own = np.array([(x, y) for j, x, y in rows if j == k])
        assert np.allclose([got[k][f"c{i}"] for i in range(4)], np.polyfit(own[:, 0], own[:, 1], 3)[::-1], atol=1e-9)
    assert got[9].c0 is None and got[9].n == 2


def test_slots_and_findings_that_repeat(spark):
    r = random.Random(5)
    updates = [(s, n, r.randrange(16)) for s in range(2) for n in r.sample(range(60), 12)]
    refs = [(s, n, r.randrange(4), f"x{n}") for s in range(2) for n in range(60)]
    got = P.slot_references(spark.createDataFrame(refs, "stream int, n int, slot int, note string"), spark.createDataFrame(updates, "stream int, n int, mask long"), 4)
    want = [(s, n, k, x, max((m for t, m, mask in updates if t == s and m < n and mask >> k & 1), default=None)) for s, n, k, x in refs]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
    once = P.first_of_each(spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, "a", 1)], "s int, rule string, n int"), ["s", "rule"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 3, 2), (2, "a", 1, 1)]
