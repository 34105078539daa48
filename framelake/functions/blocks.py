"""Kernels over 8x8 blocks held as arrays of 64 integers, row by row.

All are higher-order functions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N = 8
#: Integer 8-point DCT matrix scaled by 64 (rows are basis functions).
DCT8 = [
    [64, 64, 64, 64, 64, 64, 64, 64],
    [89, 75, 50, 18, -18, -50, -75, -89],
    [84, 35, -35, -84, -84, -35, 35, 84],
    [75, -18, -89, -50, 50, 89, 18, -75],
    [64, -64, -64, 64, 64, -64, -64, 64],
    [50, -89, 18, 75, -75, -18, 89, -50],
    [35, -84, 84, -35, -35, 84, -84, 35],
    [18, -50, 75, -89, 89, -75, 50, -18],
]


def at(x: Column, i) -> Column:
    return F.get(x, i if isinstance(i, Column) else F.lit(i))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: a lambda body would compute it again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def indexes(n: int = N * N) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def sad(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def psnr(error: Column, n: int, peak: int = 255) -> Column:
    """Infinite where there is no error."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(peak * peak * n)) / F.greatest(error, F.lit(1))))


def ssim(a: Column, b: Column, peak: int = 255) -> Column:
    """One 8x8 window with population moments."""
    n = float(N * N)
    mx, my = total(a) / n, total(b) / n
    xx, yy = total(F.transform(a, lambda v: v * v)) / n - mx * mx, total(F.transform(b, lambda v: v * v)) / n - my * my
    xy = total(F.zip_with(a, b, lambda x, y: x * y)) / n - mx * my
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return (2 * mx * my + c1) * (2 * xy + c2) / ((mx * mx + my * my + c1) * (xx + yy + c2))


def hadamard(x: Column) -> Column:
    """8x8 Walsh-Hadamard transform by butterflies: over positions that differ in one bit, six times."""

    def crossed(h: int):
        return lambda y: F.transform(indexes(), lambda i: F.when(i.bitwiseAND(h) == 0, at(y, i) + at(y, i + h)).otherwise(at(y, i - h) - at(y, i)))

    for bit in range(6):
        x = let(x, crossed(1 << bit))
    return x


def satd(a: Column, b: Column) -> Column:
    return total(F.transform(hadamard(F.zip_with(a, b, lambda x, y: x - y)), lambda v: F.abs(v)))


def transposed(x: Column) -> Column:
    return F.transform(indexes(), lambda i: at(x, (i % N) * N + F.floor(i / N).cast("int")))


def row_products(x: Column, m: list[list[int]]) -> Column:
    """x times m transposed: each row's products with the basis rows, written out term by term."""

    def row(r: Column) -> Column:
        cells = [at(x, r * N + k) for k in range(N)]
        return F.array(*[sum((cells[k] * basis[k] for k in range(1, N)), cells[0] * basis[0]) for basis in m])

    return F.flatten(F.transform(indexes(N), row))


def dct2d(x: Column, m: list[list[int]] = DCT8) -> Column:
    """m x m', as two row passes with a transposition after each."""
    rows = let(row_products(x, m), transposed)
    return let(let(rows, lambda y: row_products(y, m)), transposed)


def quantizer_step(q: Column) -> Column:
    """Own table in eighths: 24 steps an octave, doubling every 24 (q >= 1)."""
    base = F.floor(F.lit(8.0) * F.pow(F.lit(2.0), ((q - 1) % 24) / F.lit(24.0)) + 0.5).cast("long")
    return F.call_function("shiftleft", base, F.floor((q - 1) / 24).cast("int"))


def quantized(x: Column, step: Column | int, rounding: int = 128) -> Column:
    """Level: magnitude over step with rounding in 1/256, sign kept."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.transform(x, lambda v: F.signum(v).cast("long") * F.floor((F.abs(v) * 256 + rounding * step) / (step * 256)).cast("long"))


def dequantized(x: Column, step: Column | int, bits: int = 15) -> Column:
    step = F.lit(step) if isinstance(step, int) else step
    return F.transform(x, lambda v: F.greatest(F.lit(-(1 << bits)), F.least(F.lit((1 << bits) - 1), v * step)))


def residual_added(prediction: Column, residual: Column, peak: int = 255) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: F.greatest(F.lit(0), F.least(F.lit(peak), p + r)))


def paeth(above: Column, left: Column, corner: Column) -> Column:
    """Whichever of left, above, corner is nearest to above + left - corner, in this order."""
    p_left, p_above, p_corner = F.abs(above - corner), F.abs(left - corner), F.abs(above + left - 2 * corner)
    return F.when((p_left <= p_above) & (p_left <= p_corner), left).when(p_above <= p_corner, above).otherwise(corner)


def constrained(d: Column, threshold: int, damping: int) -> Column:
    """CDEF constraint of a difference."""
    if threshold == 0:
        return F.lit(0)
    adjust = max(0, damping - (threshold.bit_length() - 1))
    size = F.least(F.abs(d), F.greatest(F.lit(0), F.lit(threshold) - F.shiftright(F.abs(d), adjust)))
    return F.when(d < 0, -size).otherwise(size)


def diagonal_order(n: int = N) -> list[int]:
    """Positions of an n x n block by diagonal, then row."""
    return [r * n + c for r, c in sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[0]))]


def palette(samples: Column, size: int) -> Column:
    """Colours of a block, ascending: its most frequent values (the lower of equals), moved to the rounded mean of the samples nearest to each unless half of these are exact; null below two colours."""
    counts = F.transform(F.array_sort(F.array_distinct(samples)), lambda v: F.struct((-F.size(F.filter(samples, lambda x: x == v))).alias("less"), v.alias("value")))

    def from_runs(runs: Column) -> Column:
        seeds = F.array_sort(F.transform(F.slice(F.array_sort(runs), 1, size), lambda r: r["value"]))
        return F.get(F.transform(F.array(seeds), lambda c: F.when(F.size(runs) <= size, c).otherwise(moved(runs, c))), F.lit(0))

    def moved(runs: Column, seeds: Column) -> Column:
        nearest = lambda v: F.array_min(F.transform(seeds, lambda c: F.struct(F.abs(c - v), c.alias("seed"))))["seed"]
        placed = F.transform(runs, lambda r: F.struct(r["value"].alias("value"), (-r["less"]).cast("long").alias("n"), nearest(r["value"]).alias("seed")))
        total = lambda own, f: F.aggregate(own, F.lit(0).cast("long"), lambda a, r: a + f(r))

        def colour(c: Column) -> Column:
            own = F.filter(placed, lambda r: r["seed"] == c)
            n, exact = total(own, lambda r: r["n"]), total(own, lambda r: F.when(r["value"] == c, r["n"]).otherwise(0))
            mean = F.floor((total(own, lambda r: r["n"] * r["value"]) + F.floor(n / 2)) / n).cast("int")
            return F.when(exact * 2 < n, mean).otherwise(c)

        return F.array_sort(F.array_distinct(F.transform(seeds, colour)))

    found = F.get(F.transform(F.array(counts), from_runs), F.lit(0))
    return F.when(F.size(found) >= 2, found)
