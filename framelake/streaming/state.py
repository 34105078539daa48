"""Stateful stream operators over packets (stream, n, hint, slot mask), each with a batch twin.

State is kept for each stream by Structured Streaming; packets of a stream must arrive in
coding order over micro-batches (inside one they are sorted).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Slots of the reference buffer.
SLOTS = 8


def unit_totals(packets: DataFrame, opens: str) -> DataFrame:
    """(stream, unit, n, bits) for each unit that a later opening packet has closed; `opens` is an event type."""

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, count, bits = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("n")
        out = []
        for kind, b in zip(rows["event_type"], rows["bits"], strict=True):
            if kind == opens:
                if count:
                    out.append((key[0], unit, count, bits))
                unit, count, bits = unit + 1, 0, 0
            count, bits = count + 1, bits + int(b)
        state.update((unit, count, bits))
        yield pd.DataFrame(out, columns=["stream", "unit", "n", "bits"])

    return packets.groupBy("stream").applyInPandasWithState(close, "stream long, unit long, n long, bits long", "unit long, n long, bits long", "append", GroupStateTimeout.NoTimeout)


def display_order(packets: DataFrame) -> DataFrame:
    """(stream, n, hint, output) in display order: a shown packet emits pending smaller hints, itself, then consecutive ones.

    packets: stream, n, hint, shown.
    """

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending_h, pending_n, done = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        pending = dict(zip(pending_h, pending_n, strict=True))
        out = []

        def show(h: int, n: int) -> None:
            nonlocal done
            out.append((key[0], n, h, done))
            done += 1

        rows = pd.concat(list(batches)).sort_values("n")
        for n, h, shown in zip(rows["n"], rows["hint"], rows["shown"], strict=True):
            n, h = int(n), int(h)
            if not shown:
                pending[h] = n
                continue
            for x in sorted(x for x in pending if x < h):
                show(x, pending.pop(x))
            show(h, n)
            while h + 1 in pending:
                h += 1
                show(h, pending.pop(h))
        state.update((list(pending), list(pending.values()), done))
        yield pd.DataFrame(out, columns=["stream", "n", "hint", "output"])

    return packets.groupBy("stream").applyInPandasWithState(emit, "stream long, n long, hint long, output long", "hints array<long>, ns array<long>, done long", "append", GroupStateTimeout.NoTimeout)


def reference_slots(packets: DataFrame) -> DataFrame:
    """(stream, n, slots): the last writer of each slot before packet n, -1 if none; packets: stream, n, mask."""

    def refresh(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = list(state.get[0]) if state.exists else [-1] * SLOTS
        rows = pd.concat(list(batches)).sort_values("n")
        out = []
        for n, mask in zip(rows["n"], rows["mask"], strict=True):
            out.append((key[0], int(n), list(slots)))
            slots = [int(n) if mask >> s & 1 else x for s, x in enumerate(slots)]
        state.update((slots,))
        yield pd.DataFrame(out, columns=["stream", "n", "slots"])

    return packets.groupBy("stream").applyInPandasWithState(refresh, "stream long, n long, slots array<long>", "slots array<long>", "append", GroupStateTimeout.NoTimeout)


def window_totals(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time totals for the driver's events: rows later than the watermark are dropped by the engine."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select("w.start", "event_type", "n", "value")
