from pyspark.sql import functions as F

from framelake.operators import ordered as O
from framelake.operators import rules as R


def test_as_of_takes_the_latest_strictly_earlier(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 6, "c"), (2, 9, "d")], "k int, at int, v string")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (3, 1, "z")], "k int, at int, p string")
    got = {r.v: r.active_p for r in O.as_of(left, right, "k", "at", ["p"]).collect()}
    assert got == {"a": None, "b": "x", "c": "y", "d": None}


def test_folds(spark):
    df = spark.createDataFrame([([5, 20, -40, 3],), ([],)], "v array<long>")
    assert [r[0] for r in df.select(O.clamped_sum(F.col("v"), -10, 10)).collect()] == [-7, 0]
    b = df.where("size(v) > 0").select(O.leaky_bucket(F.col("v"), 12, 4).alias("b")).first().b
    assert (b.level, b.overflows) == (0, 1)
    assert df.select(O.moving_estimate(F.col("v"))).first()[0] == ((3 * ((3 * 5 + 20) // 4) - 40) // 4 * 3 + 3) // 4


def test_folds_in_parts(spark):
    import random

    rng = random.Random(5)
    rows = [(k, n, rng.randint(-40, 60)) for k in range(4) for n in range((1, 3, 50, 97)[k])]
    df = spark.createDataFrame(rows, "k long, n long, v long")
    level, before = {}, {}
    for k, n, v in rows:
        if n % 3 == 0:
            before[k, n // 3] = level.get(k, 0)
        level[k] = max(-15, min(70, level.get(k, 0) + v))
    got = O.clamped_levels(O.chunks(df.repartition(3), "k", "n", "v", rows=3), "k", -15, 70).collect()
    assert {r.k: r.level for r in got} == level
    assert {(r.k, s.chunk): s.before for r in got for s in r.steps} == before
    whole = df.where("k = 3").groupBy("k").agg(O.ordered_values(["k"], ["n"], "v").alias("values"))
    assert whole.select(O.leaky_bucket(F.col("values"), 30, 7, F.lit(12))["level"]).first()[0] == _bucket([v for k, _, v in rows if k == 3], 30, 7, 12)
    state, least = {}, {}
    for k, _, v in rows:
        state[k] = v if k not in state else (3 * state[k] + v) // 4
        least[k] = min(v, least.get(k, v))
    got = O.fold_in_order(df.repartition(5), "k", "n", "v", lambda s, v: v if s is None else (3 * s + v) // 4).collect()
    assert {r.k: (r.state, r.least) for r in got} == {k: (state[k], least[k]) for k in state}
    assert O.fold_in_order(df.where("k < 0"), "k", "n", "v", max, 0).count() == 0


def _bucket(values, size, drain, level):
    for v in values:
        level = max(0, min(level + v, size) - drain)
    return level


def test_sessions_and_islands(spark):
    df = spark.createDataFrame([(1, n, k) for n, k in enumerate("aDbbDD")], "s int, n int, k string")
    assert [r.session for r in O.with_session(df, ["s"], ["n"], F.col("k") == "D").orderBy("n").collect()] == [0, 1, 1, 1, 2, 3]
    assert [r.island for r in O.islands(df, ["s"], ["n"], "k").orderBy("n").collect()] == [1, 2, 3, 3, 4, 4]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (1, 50), (2, 500)], "s int, v int")
    rules = [R.Rule("v/big", "error", "too big", F.col("v") > 40), R.Rule("v/huge", "warning", "far too big", F.col("v") > 400)]
    found = R.findings(df, rules, ["s", "v"])
    assert sorted((r.v, r.rule_id) for r in found.collect()) == [(50, "v/big"), (500, "v/big"), (500, "v/huge")]
    assert R.severity_summary(found).first().asDict() == {"errors": 2, "warnings": 1, "infos": 0}
    assert {r.s: r.accepted for r in R.accepted(found, "s", strict=False).collect()} == {1: False, 2: False}
    assert R.set_difference(found, spark.createDataFrame([("v/big",)], "rule_id string")).count() == 0
    assert R.first_findings(found, "s", ["v", "rule_id"], 1).where("s = 2").first().omitted == 1


def test_bd_rate_of_known_curves(spark):
    from framelake.operators import metrics as M

    quality = [30.0, 32.0, 34.0, 36.0, 38.0]
    rows = [("x", "a", 100 * 1.3 ** (q - 30), q) for q in quality] + [("x", "b", 110 * 1.3 ** (q - 30), q) for q in quality]
    rows += [("y", "a", 5.0, q) for q in quality] + [("y", "b", 5.0, q + 50) for q in quality]  # no overlap
    rows += [("z", "a", 5.0, 30.0), ("z", "b", 5.0, 30.0)]
    got = {r.k: r.bd_rate for r in M.bd_rate(spark.createDataFrame(rows, "k string, curve string, rate double, quality double"), "k", "a", "b").collect()}
    assert abs(got["x"] - 10) < 1e-6 and got["y"] is None and got["z"] is None
