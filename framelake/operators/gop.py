"""Group-of-pictures plan: key frames, groups between them, and the order in which a hierarchy codes them.

Which frames are keys depends on the keys before (a scene cut too near to one is passed over), so that is
an ordered machine.  All else follows from a frame's place between keys: groups of at most GROUP
frames, the last one before a key or the end shorter, and in each the same hierarchy of midpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.machines import run_batch

#: Frames in a group, and from one key to the next without a scene cut.
GROUP, KEY_INTERVAL = 8, 30


def key_frames(interval: int = KEY_INTERVAL, group: int = GROUP):
    """Machine: a key first, then every `interval` frames from the last accepted cut; a cut is accepted a group or more behind the key before it."""

    class KeyFrames:
        INPUT = "stream long, n long, cut boolean"
        OUTPUT = "stream long, n long, is_key boolean"

        def __init__(self, saved: dict | None = None):
            self.origin = (saved or {}).get("origin", 0)

        def saved(self) -> dict:
            return {"origin": self.origin}

        def step(self, n: int, cut: bool) -> Iterator[tuple]:
            since = (n - self.origin) % interval
            if cut and since >= group:
                self.origin, since = n, 0
            yield n, since == 0

        def finish(self) -> Iterator[tuple]:
            return iter(())

    return KeyFrames


def hierarchy(length: int) -> list[tuple[int, int, int, bool]]:
    """(place, layer, order of coding, shown when coded) of the frames 1..length of a group behind its anchor 0.

    The last frame is coded first and shown last; then the middle of what is left, and so on to both sides.
    """
    order: list[tuple[int, int, bool]] = []
    todo = [("group", 0, length, 0)]
    while todo:
        what, low, high, layer = todo.pop()
        if what == "group":
            order.append((high, layer, high - low == 1))
            if high - low > 1:
                todo.append(("between", low, high, layer + 1))
        elif high - low > 1:
            middle = low + (high - low) // 2
            todo += [("between", middle, high, layer), ("group", low, middle, layer)]
    return [(place, layer, k, shown) for k, (place, layer, shown) in enumerate(order)]


def plan(frames: DataFrame, interval: int = KEY_INTERVAL, group: int = GROUP) -> DataFrame:
    """(stream, n, is_key, layer, coding, shown) for frames (stream, n, cut) in display order: coding counts coded frames of a stream from 0; a frame that isn't shown when coded is shown later by reference."""
    keys = run_batch(frames, key_frames(interval, group))
    upto = Window.partitionBy("stream").orderBy("n")
    after = upto.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("stream")
    placed = keys.withColumn("_key", F.max(F.when(F.col("is_key"), F.col("n"))).over(upto)).withColumn("_next", F.min(F.when(F.col("is_key"), F.col("n"))).over(after)).withColumn("_end", F.max("n").over(whole) + 1)
    offset = F.col("n") - F.col("_key") - 1
    begin = F.col("_key") + 1 + F.floor(offset / group) * group
    length = F.least(F.lit(group), F.coalesce("_next", "_end") - begin)
    at = F.concat_ws("/", length.cast("string"), (F.col("n") - begin + 1).cast("string"))
    table = {f"{size}/{place}": (layer, order, shown) for size in range(1, group + 1) for place, layer, order, shown in hierarchy(size)}
    value = lambda layer, order, shown: F.struct(F.lit(layer).alias("layer"), F.lit(order).alias("order"), F.lit(shown).alias("shown"))
    steps = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(*v))])
    found = placed.withColumn("_step", F.when(~F.col("is_key"), F.try_element_at(steps, at))).withColumn("_first", F.when(F.col("is_key"), F.col("n")).otherwise(begin))
    coded = Window.partitionBy("stream").orderBy("_first", F.coalesce("_step.order", F.lit(0)))
    return found.select("stream", "n", "is_key", F.coalesce("_step.layer", F.lit(0)).alias("layer"), (F.row_number().over(coded) - 1).cast("long").alias("coding"), F.coalesce("_step.shown", F.lit(True)).alias("shown"))
