"""Metrics over curves: least-squares cubics and average rate differences (BD-rate), as DataFrame plans.

A cubic comes from the moments of its points, which are plain sums, so a curve of any number of points is one
row a group; the normal equations are then solved by elimination in a few projections.  Qualities
are mapped to -1..1 over a comparison's range first, which keeps the equations well conditioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4  # coefficients of a cubic


def elimination(order: int = ORDER) -> list[dict[str, str]]:
    """Stages of SQL expressions (name: expression) from moments m0.., y0.. to coefficients c0.. of a least-squares polynomial.

    Spark and other dialects share them; a stage uses names of the stages before only.
    """
    a = [[f"m{i + j}" for j in range(order)] for i in range(order)]
    b, stages = [f"y{i}" for i in range(order)], []
    for k in range(order - 1):
        stage: dict[str, str] = {}
        for i in range(k + 1, order):
            factor = f"({a[i][k]} / nullif({a[k][k]}, 0))"
            row = [a[i][j] if j <= k else f"a{k}_{i}_{j}" for j in range(order)]
            stage |= {row[j]: f"{a[i][j]} - {factor} * {a[k][j]}" for j in range(k + 1, order)}
            stage[f"b{k}_{i}"] = f"{b[i]} - {factor} * {b[k]}"
            a[i], b[i] = row, f"b{k}_{i}"
        stages.append(stage)
    for i in reversed(range(order)):
        known = " - ".join([b[i], *(f"{a[i][j]} * c{j}" for j in range(i + 1, order))])
        stages.append({f"c{i}": f"({known}) / nullif({a[i][i]}, 0)"})
    return stages


def moments(x: str, y: str, order: int = ORDER) -> dict[str, str]:
    """SQL aggregates m0..m(2 order - 2) and y0..y(order - 1)."""
    power = lambda k: " * ".join([x] * k) or "1.0"
    return {f"m{k}": f"sum(cast({power(k)} as double))" for k in range(2 * order - 1)} | {f"y{k}": f"sum(cast({power(k)} * {y} as double))" for k in range(order)}


def polynomials(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, c0..c3 of the least-squares cubic of each group; null with fewer than four different x."""
    sums = points.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(x).alias("_different"), *[F.expr(e).alias(n) for n, e in moments(x, y).items()])
    for stage in elimination():
        sums = sums.select("*", *[F.expr(e).alias(n) for n, e in stage.items()])
    return sums.select(*keys, "n", *[F.when(F.col("_different") >= ORDER, F.col(f"c{k}")).alias(f"c{k}") for k in range(ORDER)])


#: Mean of a polynomial in t between a and b, from its coefficients.
MEAN = "(" + " + ".join(f"c{k} * (" + " + ".join(" * ".join(["a"] * i + ["b"] * (k - i)) or "1.0" for i in range(k + 1)) + f") / {k + 1}.0" for k in range(ORDER)) + ")"


def bd_rate(points: DataFrame, key: str, anchor: str, other: str) -> DataFrame:
    """(key, bd_rate) from points (key, curve, rate, quality): mean rate change in percent over the shared quality range.

    Null without overlap, without one of the curves, or where a curve has fewer than four different qualities.
    """
    kept = points.where(F.col("curve").isin(anchor, other) & (F.col("rate") > 0) & F.col("quality").isNotNull())
    curve = lambda c, name: F.when(F.col("curve") == c, F.col(name))
    ranges = kept.groupBy(F.col(key).alias("_key")).agg(
        F.greatest(F.min(curve(anchor, "quality")), F.min(curve(other, "quality"))).alias("low"),
        F.least(F.max(curve(anchor, "quality")), F.max(curve(other, "quality"))).alias("high"),
        ((F.max("quality") + F.min("quality")) / 2).alias("middle"),
        F.greatest((F.max("quality") - F.min("quality")) / 2, F.lit(1e-9)).alias("half"),
        F.countDistinct("curve").alias("curves"),
    )
    scaled = kept.join(ranges, F.col(key).eqNullSafe(F.col("_key"))).withColumn("t", (F.col("quality") - F.col("middle")) / F.col("half")).withColumn("log_rate", F.log("rate"))
    fits = polynomials(scaled, [key, "curve"], "t", "log_rate")
    place = lambda c: (F.col(c) - F.col("middle")) / F.col("half")
    means = fits.join(ranges, F.col(key).eqNullSafe(F.col("_key"))).withColumn("a", place("low")).withColumn("b", place("high")).withColumn("mean", F.expr(MEAN))
    mean = lambda c: F.max(F.when(F.col("curve") == c, F.col("mean")))
    usable = (F.max("curves") == 2) & (F.max("high") > F.max("low"))
    return means.groupBy(key).agg(F.when(usable, (F.exp(mean(other) - mean(anchor)) - 1) * 100).alias("bd_rate"))
