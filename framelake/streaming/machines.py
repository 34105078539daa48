"""Ordered state machines over streams of rows, in batches and in Structured Streaming.

A machine takes the rows of one stream in order of `n`, which counts them from 0, and gives rows.
`run_batch` sorts each stream and passes its rows by one after the other; `run_stream` keeps the machine
in the state store.  Rows that come before their turn wait there too, so the result is the same for any
order of arrival and any cut into micro-batches.  A stream ends with a row whose `ended` is true (its n is
the number of rows), or once nothing has come for `idle_ms`; then the machine gives what it still holds.

    OutputSchedule  frames in the order in which a decoder shows them
    UnitTotals      rows and bits of units, the last one included
    OrderChecks     findings about the order of units, phases and layers

A machine's state is small and bounded; waiting rows are on the state store's disk (use the RocksDB provider).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Unit types that count as regular frames for an open-loop boundary, and the open-loop key.
REGULAR = {5, 7, 10, 12, 14, 19, 21}
OPEN_LOOP = 5
SLOTS = 8


class OutputSchedule:
    """Reference slots that hold frames to be shown later.

    rows: hint, kind (unit type), first (in its temporal unit), immediate, implicit, mask (slots that the
    frame refreshes), key (key or switch frame).  A frame shown at once first lets out held frames of
    lower hints and then those that follow it without a gap.  A frame that refreshes a slot lets out the
    one held there, in the same way.  An implicit frame is held by the slots that it refreshes, a key
    frame by the first of them only.  The first regular frame of a unit behind an open-loop key lets out
    all held frames under the hint of that key, or of a later frame of its unit.
    """

    INPUT = "stream long, n long, hint long, kind int, first boolean, immediate boolean, implicit boolean, mask int, key boolean"
    OUTPUT = "stream long, position long, n long, hint long"

    def __init__(self, saved: dict | None = None):
        s = saved or {}
        self.held: list[list[int] | None] = s.get("held", [None] * SLOTS)  # [n, hint]
        self.open, self.limit, self.shown = s.get("open", False), s.get("limit"), s.get("shown", 0)

    def saved(self) -> dict:
        return {"held": self.held, "open": self.open, "limit": self.limit, "shown": self.shown}

    def _show(self, n: int, hint: int) -> Iterator[tuple]:
        yield self.shown, n, hint
        self.shown += 1
        self.held = [None if h and h[0] == n else h for h in self.held]

    def _below(self, limit: int | None) -> Iterator[tuple]:
        while some := [h for h in self.held if h and (limit is None or h[1] < limit)]:
            yield from self._show(*min(some, key=lambda h: h[1]))

    def _around(self, n: int, hint: int) -> Iterator[tuple]:
        yield from self._below(hint)
        yield from self._show(n, hint)
        while some := [h for h in self.held if h and h[1] == hint + 1]:
            for h in some:
                if h in self.held:
                    yield from self._show(*h)
            hint += 1

    def step(self, n: int, hint: int, kind: int, first: bool, immediate: bool, implicit: bool, mask: int, key: bool) -> Iterator[tuple]:
        regular = kind in REGULAR
        if self.open and first and regular:
            limit, self.open, self.limit = self.limit, False, None
            yield from self._below(limit)
        fresh, out = True, False
        for slot in range(SLOTS):
            if mask >> slot & 1:
                if self.held[slot]:
                    for shown in self._around(*self.held[slot]):
                        out = out or shown[1] == n  # it followed the one let out, from an earlier slot
                        yield shown
                self.held[slot] = [n, hint] if implicit and (fresh or not key) and not out else None
                fresh = False
        if kind == OPEN_LOOP:
            self.open, self.limit = True, hint if implicit else None
        elif self.open and regular and not first and (immediate or implicit):
            self.limit = hint
        if immediate:
            yield from self._around(n, hint)

    def finish(self) -> Iterator[tuple]:
        yield from self._below(None)


class UnitTotals:
    """(unit, first_n, rows, bits) of runs that begin with a row whose `opens` is true; rows before the first are unit 0."""

    INPUT = "stream long, n long, opens boolean, bits long"
    OUTPUT = "stream long, unit long, first_n long, rows long, bits long"

    def __init__(self, saved: dict | None = None):
        s = saved or {}
        self.unit, self.first, self.rows, self.bits = (s.get(k, 0) for k in ("unit", "first", "rows", "bits"))

    def saved(self) -> dict:
        return {"unit": self.unit, "first": self.first, "rows": self.rows, "bits": self.bits}

    def step(self, n: int, opens: bool, bits: int) -> Iterator[tuple]:
        if opens:
            yield from self.finish()
            self.unit, self.first, self.rows, self.bits = self.unit + 1, n, 0, 0
        self.rows, self.bits = self.rows + 1, self.bits + bits

    def finish(self) -> Iterator[tuple]:
        if self.rows:
            yield self.unit, self.first, self.rows, self.bits


class OrderChecks:
    """(n, rule_id, severity) of what is out of order: rows have unit type, phase and layer.

    A verdict about a temporal unit that its end settles (no frame in it) is reported at the delimiter that began it.
    """

    INPUT = "stream long, n long, kind int, phase int, layer int"
    OUTPUT = "stream long, n long, rule_id string, severity string"
    DELIMITER, FRAMES = 2, {4, 5, 6, 7, 10, 11, 12, 13, 14, 19, 21}

    def __init__(self, saved: dict | None = None):
        s = saved or {}
        self.began, self.phase, self.layer, self.frames, self.last = s.get("began"), s.get("phase", -1), s.get("layer", -1), s.get("frames", 0), s.get("last")

    def saved(self) -> dict:
        return {"began": self.began, "phase": self.phase, "layer": self.layer, "frames": self.frames, "last": self.last}

    def step(self, n: int, kind: int, phase: int, layer: int) -> Iterator[tuple]:
        if kind == self.DELIMITER:
            if self.last == self.DELIMITER:
                yield n, "unit/duplicate-delimiter", "error"
            else:
                yield from self.finish()
            self.began, self.phase, self.layer, self.frames = n, -1, -1, 0
        else:
            if self.began is None and self.last is None:
                yield n, "unit/missing-delimiter", "error"
            if phase < self.phase:
                yield n, "unit/phase-order", "error"
            if layer < self.layer:
                yield n, "unit/layer-order", "warning"
            self.phase, self.layer = max(phase, self.phase), layer
            self.frames += kind in self.FRAMES
        self.last = kind

    def finish(self) -> Iterator[tuple]:
        if self.began is not None and not self.frames:
            yield self.began, "unit/no-frame", "warning"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def run_batch(rows: DataFrame, machine: Callable) -> DataFrame:
    """The machine's rows for whole streams; a stream's rows pass one at a time through one task."""
    names, out = _columns(machine.INPUT), _columns(machine.OUTPUT)
    ordered = rows.select(*names).repartition("stream").sortWithinPartitions("stream", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, m, made = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if m is None or row[0] != stream:
                    if m is not None:
                        made += [(stream, *x) for x in m.finish()]
                    stream, m = row[0], machine()
                made += [(stream, *x) for x in m.step(*row[1:])]
            yield pd.DataFrame(made, columns=out)
            made = []
        if m is not None:
            yield pd.DataFrame([(stream, *x) for x in m.finish()], columns=out)

    return ordered.mapInPandas(run, machine.OUTPUT)


class InOrder(StatefulProcessor):
    """Feeds a machine the rows of a stream in order of n; rows that are early wait in a map."""

    def __init__(self, machine: Callable, idle_ms: int | None):
        self.machine, self.idle = machine, idle_ms
        self.names, self.out = _columns(machine.INPUT), _columns(machine.OUTPUT)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "saved string, due long, waiting long, ends long")
        rest = ", ".join(c for c in self.machine.INPUT.split(", ") if c.split()[0] not in ("stream", "n"))
        self.early = handle.getMapState("early", "n long", rest)

    def _finished(self, m) -> list[tuple]:
        self.state.clear()
        self.early.clear()
        return list(m.finish())

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        saved, due, waiting, ends = self.state.get() if self.state.exists() else (None, 0, 0, None)
        m = self.machine(json.loads(saved) if saved else None)
        for pdf in rows:
            made = []
            for row in pdf.itertuples(index=False, name=None):
                n, rest = int(row[1]), row[2:-1]
                if row[-1]:
                    ends = n
                elif n == due:
                    made += m.step(n, *_plain(rest))
                    due += 1
                    while waiting and self.early.containsKey((due,)):
                        made += m.step(due, *_plain(self.early.getValue((due,))))
                        self.early.removeKey((due,))
                        due, waiting = due + 1, waiting - 1
                elif n > due and not self.early.containsKey((n,)):  # one below was delivered twice
                    self.early.updateValue((n,), tuple(_plain(rest)))
                    waiting += 1
            yield self._frame(key, made)
        if ends is not None and due >= ends:
            yield self._frame(key, self._finished(m))
            return
        self.state.update((json.dumps(m.saved()), due, waiting, ends))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            saved = self.state.get()[0]
            yield self._frame(key, self._finished(self.machine(json.loads(saved))))

    def _frame(self, key, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in made], columns=self.out)

    def close(self) -> None:
        pass


def _plain(values) -> list:
    return [v.item() if hasattr(v, "item") else v for v in values]


def run_stream(rows: DataFrame, machine: Callable, idle_ms: int | None = None) -> DataFrame:
    """The machine's rows of streaming rows, which have a column `ended` more."""
    names = _columns(machine.INPUT)
    kept = rows.select(*names, F.coalesce(F.col("ended"), F.lit(False)).alias("ended"))
    return kept.groupBy("stream").transformWithStateInPandas(InOrder(machine, idle_ms), machine.OUTPUT, "append", "processingTime" if idle_ms is not None else "none")
