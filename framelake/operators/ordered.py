"""Operators over records in stream order: units, sessions, order checks, as-of look-ups, folds.

Every window is partitioned by the stream key, so streams run in parallel and nothing is
gathered across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_session(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "session") -> DataFrame:
    """Numbers event-delimited sessions: a row where `starts` holds opens one; rows before the first are session 0."""
    return df.withColumn(name, F.sum(starts.cast("int")).over(order_within(keys, order)))


def with_previous(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(order_within(keys, order)))


def below_running_max(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose value lies below the largest earlier one of their group."""
    return df.withColumn("running_max", F.max(column).over(before(order_within(keys, order)))).where(F.col(column) < F.col("running_max"))


def islands(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Runs of equal values, numbered from 1 in each group as `island`."""
    change = ~F.col(column).eqNullSafe(F.lag(column).over(order_within(keys, order))) | (F.row_number().over(order_within(keys, order)) == 1)
    return df.withColumn("_change", change).withColumn("island", F.sum(F.col("_change").cast("int")).over(order_within(keys, order))).drop("_change")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """left with the payload of the latest right row of the same key strictly before it in `at`.

    The sides are stacked and the payload is carried forward by a window, so a key's rows are
    sorted once and no range join is needed.  Right rows at the same `at` come after.
    """
    r = right.select(F.col(key), F.col(at), F.lit(1).alias("_side"), F.struct(*payload).alias("_payload"))
    extra = [c for c in left.columns if c not in (key, at)]
    stacked = left.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_payload"].dataType).alias("_payload"), F.struct(*extra).alias("_row")).unionByName(r.withColumn("_row", F.lit(None)))
    w = before(Window.partitionBy(key).orderBy(at, "_side"))
    found = stacked.withColumn("_found", F.last("_payload", ignorenulls=True).over(w)).where("_side = 0")
    return found.select(key, at, *[F.col(f"_row.{c}").alias(c) for c in extra], *[F.col(f"_found.{c}").alias(f"active_{c}") for c in payload])


def ordered_values(keys: list[str], order: list[str], value: str):
    """Aggregate expression: the values of a group in order, for a fold."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])


def clamped_sum(values: Column, low: int, high: int) -> Column:
    """Running sum that is clamped after every step; not a window sum."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: F.greatest(F.lit(low), F.least(F.lit(high), s + v)).cast("long"))


def leaky_bucket(values: Column, size: int, drain: int, level: Column | None = None) -> Column:
    """(level, overflows): each value fills the bucket, which then drains to 0 at least; level is what it holds at first (none: 0)."""
    start = F.struct((F.lit(0) if level is None else level).cast("long").alias("level"), F.lit(0).alias("overflows"))

    def step(s: Column, v: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(0).cast("long"), F.least(s.level + v, F.lit(size).cast("long")) - drain).alias("level"),
            (s.overflows + (s.level + v > size).cast("int")).alias("overflows"),
        )

    return F.aggregate(values, start, step)


def moving_estimate(values: Column) -> Column:
    """The first value, then (3 old + new) div 4."""
    return F.aggregate(values, F.lit(None).cast("long"), lambda s, v: F.when(s.isNull(), v).otherwise(F.floor((3 * s + v) / 4).cast("long")))


#: Rows of a group that are folded at once; longer groups are cut into chunks of so many.
CHUNK = 65_536


def chunks(df: DataFrame, key: str, at: str, value: str, rows: int = CHUNK) -> DataFrame:
    """(key, chunk, values): the values of a group in order, so many a row; `at` counts a group's rows from 0."""
    return df.groupBy(key, F.floor(F.col(at) / rows).alias("chunk")).agg(ordered_values([key], [at], value).alias("values"))


def _clamped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x)).cast("long")


def clamped_levels(parts: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, steps, level) for chunks: what a sum from 0 that is clamped after every value reaches.

    A run of such steps is itself a clamped shift, s -> clamp(s + shift, low, high), so each chunk is
    folded by itself into three numbers and those of a group are applied in order.  steps holds
    (chunk, level before it).
    """
    lo, hi = F.lit(low).cast("long"), F.lit(high).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("shift"), lo.alias("low"), hi.alias("high"))
    run = F.aggregate("values", start, lambda m, v: F.struct((m["shift"] + v).alias("shift"), _clamped(m["low"] + v, lo, hi).alias("low"), _clamped(m["high"] + v, lo, hi).alias("high")))
    runs = parts.select(key, "chunk", run.alias("run")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "run"))).alias("runs"))
    zero = F.array(F.lit(0).cast("long"))
    reached = F.aggregate("runs", zero, lambda s, c: F.concat(s, F.array(_clamped(F.element_at(s, -1) + c["run"]["shift"], c["run"]["low"], c["run"]["high"]))))
    found = runs.select(key, F.transform("runs", lambda c: c["chunk"]).alias("chunk"), reached.alias("before"))
    return found.select(key, F.arrays_zip("chunk", F.slice("before", 1, F.size("chunk")).alias("before")).alias("steps"), F.element_at("before", -1).alias("level"))


def fold_in_order(df: DataFrame, key: str, at: str, value: str, step, start: int | None = None) -> DataFrame:
    """(key, state, least): the values of each key taken in order by step(state, value), and the least of them.

    For steps that can't be joined from parts.  Rows are sorted within their partition and pass by
    one after the other, so a long group needs no memory of its own; it stays one task's work.
    """
    import pyarrow as pa

    rows = df.select(key, at, F.col(value).cast("long").alias("_v")).repartition(key).sortWithinPartitions(key, at)

    def folded(batches):
        now, state, least, some = None, start, None, False
        for b in batches:
            done = []
            for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not some or k != now:
                    if some:
                        done.append((now, state, least))
                    now, state, least, some = k, start, None, True
                if v is not None:
                    state, least = step(state, v), v if least is None else min(v, least)
            yield result(done)
        if some:
            yield result([(now, state, least)])

    def result(done):
        columns = list(zip(*done, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[key, "state", "least"])

    return rows.mapInArrow(folded, f"{key} long, state long, least long")
