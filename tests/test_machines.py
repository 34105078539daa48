import random

import pytest
from pyspark.sql import functions as F

from framelake.streaming import machines as M


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def frames(seed, streams=3, n=60):
    r = random.Random(seed)
    rows = []
    for s in range(streams):
        for k in range(n):
            immediate = r.random() < 0.4
            rows.append((s, k, r.randrange(max(0, k - 5), k + 6), r.choice([4, 5, 6, 7, 7, 10, 12]), r.random() < 0.5, immediate, not immediate and r.random() < 0.7, r.choice([0, 1, 2, 5, 128, 255]), r.random() < 0.2))
    return rows


def plain_schedule(rows):
    """Another way to the order: a list of (slot, n, hint), looked through anew for each question."""
    out, held, opened, limit = [], [], False, None

    def show(n, hint):
        out.append((n, hint))
        held[:] = [h for h in held if h[1] != n]

    def lower(than):
        while any(than is None or h[2] < than for h in held):
            best = min((h for h in held if than is None or h[2] < than), key=lambda h: (h[2], h[0]))
            show(best[1], best[2])

    def around(n, hint):
        lower(hint)
        show(n, hint)
        while any(h[2] == hint + 1 for h in held):
            while any(h[2] == hint + 1 for h in held):
                h = min(h for h in held if h[2] == hint + 1)
                show(h[1], h[2])
            hint += 1

    for _, n, hint, kind, first, immediate, implicit, mask, key in rows:
        regular = kind in (5, 7, 10, 12, 14, 19, 21)
        if opened and first and regular:
            opened, top, limit = False, limit, None
            lower(top)
        slots = [s for s in range(8) if mask & 1 << s]
        for s in slots:
            for h in [h for h in held if h[0] == s]:
                around(h[1], h[2])
            held[:] = [h for h in held if h[0] != s]
            if implicit and (s == slots[0] or not key) and n not in [x[0] for x in out]:
                held.append((s, n, hint))
        if kind == 5:
            opened, limit = True, hint if implicit else None
        elif opened and regular and not first and (immediate or implicit):
            limit = hint
        if immediate:
            around(n, hint)
    lower(None)
    return [(k, n, h) for k, (n, h) in enumerate(out)]


def test_schedule_of_whole_streams(spark):
    for seed in range(3):
        rows = frames(seed)
        got = M.run_batch(spark.createDataFrame(rows, M.OutputSchedule.INPUT).repartition(4), M.OutputSchedule)
        want = [(s, *x) for s in range(3) for x in plain_schedule([r for r in rows if r[0] == s])]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        for s in range(3):  # every frame that is to be shown is, once
            shown = [r[2] for r in want if r[0] == s]
            assert len(shown) == len(set(shown)) and {r[1] for r in rows if r[0] == s and r[5]} <= set(shown)


def streamed(spark, tmp_path, machine, batches, ended, idle=None):
    """Rows of each batch in files of their own, read one file a micro-batch."""
    schema = machine.INPUT + ", ended boolean"
    folder = tmp_path / "in"
    for k, batch in enumerate([*batches, ended]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = M.run_stream(source, machine, idle).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(machine.OUTPUT).parquet(f"{tmp_path}/out").collect())


def cut(rows, width, shuffle, seed):
    r = random.Random(seed)
    rows = [(*x, False) for x in rows]
    if shuffle:
        r.shuffle(rows)
    else:
        rows.sort(key=lambda x: x[1])
    return [rows[a : a + width] for a in range(0, len(rows), width)]


@pytest.mark.parametrize(("width", "shuffle"), [(25, False), (60, True)])
def test_any_cut_gives_the_batch_result(spark, tmp_path, width, shuffle):
    rows = frames(7, streams=2, n=60)
    ended = [(s, 60, 0, 0, False, False, False, 0, False, True) for s in range(2)]
    want = sorted(tuple(r) for r in M.run_batch(spark.createDataFrame(rows, M.OutputSchedule.INPUT), M.OutputSchedule).collect())
    assert streamed(spark, tmp_path, M.OutputSchedule, cut(rows, width, shuffle, 1), ended) == want


def test_the_last_unit_comes_out(spark, tmp_path):
    r = random.Random(2)
    rows = [(s, k, r.random() < 0.2, r.randrange(100)) for s in range(3) for k in range(40)]
    ended = [(s, 40, False, 0, True) for s in range(3)]
    want = sorted(tuple(x) for x in M.run_batch(spark.createDataFrame(rows, M.UnitTotals.INPUT), M.UnitTotals).collect())
    assert streamed(spark, tmp_path, M.UnitTotals, cut(rows, 50, True, 3), ended) == want
    assert sum(w[3] for w in want) == 120 and sum(w[4] for w in want) == sum(x[3] for x in rows)


def test_totals_equal_a_window(spark):
    r = random.Random(3)
    rows = [(s, k, r.random() < 0.3, r.randrange(100)) for s in range(4) for k in range(50)]
    df = spark.createDataFrame(rows, M.UnitTotals.INPUT)
    from pyspark.sql import Window

    unit = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("stream").orderBy("n"))
    want = df.withColumn("unit", unit).groupBy("stream", "unit").agg(F.min("n"), F.count("*"), F.sum("bits"))
    assert sorted(map(tuple, M.run_batch(df, M.UnitTotals).collect())) == sorted(map(tuple, want.collect()))


def test_checks_as_a_stream_and_by_hand(spark, tmp_path):
    kinds = [(2, 0, 0), (1, 1, 0), (4, 2, 0), (7, 2, 1), (1, 1, 1), (2, 0, 0), (2, 0, 0), (9, 3, 0), (2, 0, 0), (7, 2, 2), (7, 2, 1)]
    rows = [(1, n, *k) for n, k in enumerate(kinds)] + [(2, 0, 7, 2, 0)]
    want = [(1, 4, "unit/phase-order", "error"), (1, 6, "unit/duplicate-delimiter", "error"), (1, 6, "unit/no-frame", "warning"), (1, 10, "unit/layer-order", "warning"), (2, 0, "unit/missing-delimiter", "error")]
    assert sorted(map(tuple, M.run_batch(spark.createDataFrame(rows, M.OrderChecks.INPUT), M.OrderChecks).collect())) == want
    ended = [(1, len(kinds), 0, 0, 0, True), (2, 1, 0, 0, 0, True)]
    assert streamed(spark, tmp_path, M.OrderChecks, cut(rows, 4, True, 5), ended) == want


def test_plans_of_groups(spark, tmp_path):
    from framelake.operators import gop

    def steps(low, high, layer=0):
        """Coded frames between an anchor and the last frame of a group, by recursion."""
        out = [(high, layer, high - low == 1)]
        low, layer = low, layer + 1
        while high - low > 1:
            middle = low + (high - low) // 2
            out += steps(low, middle, layer)
            low = middle
        return out

    for n in range(1, 20):
        assert [(p, layer, shown) for p, layer, _, shown in gop.hierarchy(n)] == steps(0, n)
        assert sorted(p for p, *_ in gop.hierarchy(n)) == list(range(1, n + 1))
    assert [p for p, *_ in gop.hierarchy(8)] == [8, 4, 2, 1, 3, 6, 5, 7] and [p for p, *_ in gop.hierarchy(3)][0] == 3
    r = random.Random(6)
    rows = [(s, n, r.random() < 0.1) for s in range(3) for n in range(70 + s)]
    got = gop.plan(spark.createDataFrame(rows, "stream long, n long, cut boolean").repartition(4), interval=25, group=8)
    for s in range(3):
        own = sorted((x for x in got.collect() if x.stream == s), key=lambda x: x.n)
        want, keys, last = [], [], 0
        for n in range(70 + s):
            if rows[[x[:2] for x in rows].index((s, n))][2] and (n - last) % 25 >= 8:
                last = n
            if (n - last) % 25 == 0:
                keys.append(n)
        for a, b in zip(keys, [*keys[1:], 70 + s], strict=True):
            want.append((a, 0, True))
            for first in range(a + 1, b, 8):
                want += [(first - 1 + p, layer, shown) for p, layer, shown in steps(0, min(8, b - first))]
        assert [x.n for x in own if x.is_key] == keys
        assert [(x.n, x.layer, x.shown) for x in sorted(own, key=lambda x: x.coding)] == want
    machine = gop.key_frames(25, 8)
    batch = sorted(tuple(x) for x in M.run_batch(spark.createDataFrame(rows, machine.INPUT), machine).collect())
    assert batch == sorted((x.stream, x.n, x.is_key) for x in got.collect())
