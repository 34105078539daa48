"""Sharding: minimax contiguous partition of atomic groups.

Groups (rows of equal texts) stand in the order of a 128-bit hash of their text.  The
smallest shard capacity is found by binary search; whether a capacity is feasible is checked
greedily over the ordered group sizes.  The sizes stay distributed: the driver holds sums
over cells (ranges of the hash, 65,536 at first) and asks for finer cells only where a cut
falls into a cell of several groups.  A greedy cut fills shard after shard and starves the last,
so the cuts taken are those next to equal shares among all of the smallest capacity.  Cuts are values of the hash, so each row finds its
shard by comparing its own hash with them: there is no join.

Defined results: a null text counts as empty and shares its group; all rows of a group, also
repeated rows, are in one shard; an empty table gives no rows; trailing shards may be empty
when groups are fewer than shards; a very long text is one
group like others and may make its shard larger than the rest; other columns are kept or dropped, never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, text_key, text_or_empty

#: Bytes of the hash that tell the first cells apart.
FIRST_BYTES = 2
SHARDS = 24
#: Bytes that a row counts beside its text.
ROW_BYTES = 8


class Cells:
    """Sums over ranges of the ordered groups; `refine` replaces cells by their 256 parts."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = self._sums(groups, FIRST_BYTES)
        self.prefix = [bytes(r.cell) for r in rows]
        self.size = np.array([r.size for r in rows], np.int64)
        self.count = np.array([r.n for r in rows], np.int64)
        self._sum_up()
        self.largest = groups.agg(F.max("size")).first()[0] or 0

    @staticmethod
    def _sums(groups: DataFrame, width: int):
        return groups.groupBy(F.substring("key", 1, width).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("cell").collect()  # at most 65,536 rows, or 256 for each cell asked for

    def _sum_up(self) -> None:
        self.end = np.cumsum(self.size)

    def level(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Cuts as near to equal shares as no shard over capacity allows, and the cells of several groups that a bound or share met."""
        edges, met, n = np.r_[0, self.end], set(), len(self.end)

        def meet(place: float) -> None:
            at = int(np.searchsorted(self.end, place, side="right"))
            if at < n and edges[at] < place and self.count[at] > 1:
                met.add(at)

        # from the end: the first place where a shard may begin so that the rest fits into those that remain
        first, place = [0] * shards, self.total
        for s in range(shards - 1, 0, -1):
            meet(place - capacity)
            first[s] = int(np.searchsorted(edges, place - capacity, side="left"))
            place = int(edges[first[s]])
        cuts, before = [], 0
        for s in range(1, shards):
            share, limit = self.total * s / shards, int(edges[before]) + capacity
            meet(share)
            meet(limit)
            last = int(np.searchsorted(edges, limit, side="right")) - 1
            at = min(int(np.searchsorted(edges, share)), n)
            if at and share - edges[at - 1] < edges[at] - share:
                at -= 1
            before = max(before, min(max(at, first[s]), last))
            cuts.append(before)
        return cuts, met

    @property
    def total(self) -> int:
        return int(self.end[-1]) if len(self.end) else 0

    def refine(self, cells: set[int]) -> None:
        finer: dict[bytes, list] = {}
        for width in {len(self.prefix[c]) for c in cells}:
            asked = [self.prefix[c] for c in cells if len(self.prefix[c]) == width]
            for r in self._sums(self.groups.where(F.substring("key", 1, width).isin(asked)), width + 1):
                finer.setdefault(bytes(r.cell)[:width], []).append((bytes(r.cell), r.size, r.n))
        rows = []
        for i, p in enumerate(self.prefix):
            rows += finer[p] if i in cells else [(p, self.size[i], self.count[i])]
        self.prefix = [r[0] for r in rows]
        self.size = np.array([r[1] for r in rows], np.int64)
        self.count = np.array([r[2] for r in rows], np.int64)
        self._sum_up()

    def greedy(self, capacity: int, shards: int, whole: bool) -> tuple[bool, list[int], set[int]]:
        """Fill shard after shard.  whole: cells are atoms; else cells of several groups can be cut anywhere.

        Whether all fits, the first cell of each later shard, the cells of several groups that a cut met.
        """
        start, cuts, met, n = 0, [], set(), len(self.end)
        for _ in range(shards):
            if start >= self.total:
                break
            at = int(np.searchsorted(self.end, start + capacity, side="right"))  # the first cell that doesn't fit
            if at >= n:
                return True, cuts, met
            if self.count[at] > 1:
                met.add(at)
            below = int(self.end[at - 1]) if at else 0
            reach = below if whole or self.count[at] == 1 else start + capacity
            if reach <= start:
                return False, cuts, met
            start = reach
            cuts.append(at)
        return start >= self.total, cuts, met


def shard_cuts(groups: DataFrame, shards: int) -> list[bytes]:
    """Hash values at which shards 1, 2, ... begin: no shard is over the smallest feasible capacity, and cuts lie next to equal shares."""
    cells = Cells(groups)
    if not cells.total:
        return []

    def feasible(capacity: int) -> bool:
        while True:
            ok, _, met = cells.greedy(capacity, shards, whole=True)
            if ok:
                return True
            can, _, met_too = cells.greedy(capacity, shards, whole=False)
            if not can or not (met | met_too):
                return False
            cells.refine(met | met_too)

    low, high = max(cells.largest, -(-cells.total // shards)), cells.total
    while low < high:
        middle = (low + high) // 2
        # near the end of the search capacities differ by less than a group, so cells met are refined once each
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    while True:
        cuts, met = cells.level(low, shards)
        if not met:
            return [cells.prefix[c] for c in cuts if c < len(cells.prefix)]
        cells.refine(met)


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Sizes follow the law `bytes`; slots count from 0 in each shard by (doc_id, text hash).
    """
    text = text_or_empty(text_column)
    rows = cut(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key(text_column).alias("key"),
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    shard = F.lit(0)
    for key in shard_cuts(groups, shards):
        shard = shard + (F.col("key") >= F.lit(bytearray(key))).cast("int")
    placed = numbered(rows.withColumn("shard", shard), "doc_id", "key", within="shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("row_no").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
