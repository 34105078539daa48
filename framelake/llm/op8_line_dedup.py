"""Line dedup: repeated runs of lines, by a suffix array over line-ID sequences built by prefix doubling.

A line occurrence is a position; positions follow (doc_id, line number), with one position
left free behind each document, so that no run crosses a document's end.  A line's ID is 128 bits
of its MD5 hash.

Suffix array.  In round k a suffix's name is its rank by its first 2^k lines: the pairs
(rank, rank 2^k lines further on) that occur twice or more are sorted by ranges and numbered,
which gives the ranks of the next round.  Each round is a join, an aggregation and a sort of the
distinct pairs; suffixes whose prefix occurs once are settled and leave.  (Their order
among each other shows no repeat, so it is not made.)

LCP intervals.  Suffixes of equal rank are an interval of the suffix array that shares
a prefix of 2^k lines.  Going down the rounds, an interval of any length is split by the rank of
what follows: a suffix moves to the longer interval if that has an earlier member; the first
suffix of an interval stays and also represents it in later steps.  So each suffix ends in
the longest interval that holds an earlier suffix, and its length is the longest common
prefix with an earlier suffix.  A run of at least MIN_WORDS words that is the copy of an earlier
one is deleted; the earliest stays.

Defined results: a null text counts as empty; runs don't cross documents; overlapping copies
of a run inside a document are deleted but for the first; rows that repeat in doc_id and
text are later copies of each other; a document that is all copy keeps an empty text; a text
may have any number of lines; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table, numbered, text_key, text_or_empty

#: Words in a repeated run from which later copies go.
MIN_WORDS = 50
#: Rows whose lines are counted up in one task, when positions are given out.
ROWS_AT_ONCE = 65_536
#: Rows of a group from which it may count as hot.
HOT_ROWS = 2000


def line_id(line):
    """128 bits that stand for a line."""
    return F.unhex(F.md5(line.cast("binary")))


def words_in(line):
    """Words (runs of other characters than blanks) of a text without newlines.

    Where single spaces alone part the words, the spaces are counted, which is cheaper than the words.
    """
    plain = ~(F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == ""))
    for other in ("  ", "\t", "\x0b", "\f", "\r"):
        plain = plain & ~F.contains(line, F.lit(other))
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(plain, blanks + 1).otherwise(F.regexp_count(line, F.lit(r"\S+")))


def _lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, d, h, words) for each line; (d, doc_id, key, n_lines, n_words) for each row; d is the position of a row's first line."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("rid", F.monotonically_increasing_id()).withColumn("key", text_key()).withColumn("split", F.split("text", "\n"))
    lines = rows.select("rid", F.struct("doc_id", "key", F.size("split").alias("n_lines")).alias("row"), F.posexplode("split").alias("pos", "line"))
    lines = cut(lines.select("rid", "pos", line_id(F.col("line")).alias("h"), words_in(F.col("line")).alias("words"), F.when(F.col("pos") == 0, F.col("row")).alias("row")))
    order = cut(numbered(lines.where("pos = 0").select("rid", "row.*"), "doc_id", "rid").withColumn("part", F.expr(f"row_no div {ROWS_AT_ONCE}")))
    # positions: the lines of all parts before, then those of rows before in the part
    parts = order.groupBy("part").agg(F.sum(F.col("n_lines") + 1).alias("n"))  # a row for each ROWS_AT_ONCE rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    order = order.withColumn("above", F.coalesce(F.sum(F.col("n_lines") + 1).over(inside), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    order = cut(order.select("rid", (F.col("start") + F.col("above")).alias("d"), "doc_id", "key", "n_lines"))
    placed = cut(lines.join(order.select("rid", "d"), "rid").select((F.col("d") + F.col("pos")).alias("p"), "d", "h", "words"))
    drop_table(lines)
    sizes = placed.groupBy("d").agg(F.sum("words").alias("n_words"))
    return placed, order.drop("rid").join(sizes, "d")


def _with_first(rows: DataFrame, by: list[str], ranked: bool = False) -> DataFrame:
    """rows with `first`: the least p among rows equal in `by`, null where there is no other such row or `by` has a null.

    With ranked, also `rank`: the place of the row's values among the repeated ones.  Groups of
    over a thousandth of the rows (so a thousand at most) are joined by a broadcast, where
    their rows are; for the shuffle join of the others their rows get keys of their own, so
    that no task gathers a group.
    """
    valid = rows.dropna(subset=by)
    groups = valid.groupBy(*by).agg(F.min("p").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = numbered(groups, *by).withColumnRenamed("row_no", "rank") if ranked else groups
    groups = cut(groups)
    out = ["first", "rank"] if ranked else ["first"]
    carried = F.struct(*out)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = groups.where(F.col("n") > max(HOT_ROWS, total // 1000)).select(*by, carried.alias("_large"))
    small = groups.where(F.col("n") <= max(HOT_ROWS, total // 1000)).select(*by, carried.alias("_small"))
    marked = rows.join(F.broadcast(large), by, "left").withColumn("_own", F.when(F.col("_large").isNotNull() | F.col(by[0]).isNull(), -F.col("p") - 2))
    spread = marked.withColumn("_k", F.coalesce("_own", F.xxhash64(*by)))
    small = small.withColumn("_k", F.xxhash64(*by)).select("_k", *[F.col(c).alias(f"_{c}") for c in by], "_small")
    same = F.col("_own").isNull()
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = spread.join(small, (spread["_k"] == small["_k"]) & same, "left").withColumn("_found", F.coalesce("_large", "_small"))
    return joined.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in out])


def _rounds(lines: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate lines (p, d, words_before, words_upto) and the ranks (p, rank) of their runs of 1, 2, 4, ... lines."""
    active = _with_first(lines, ["h"], ranked=True).where("first is not null").select("p", "d", "words", "rank")
    # consecutive repeated lines with too few words together can't hold a run
    island = active.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy("d").orderBy("p")))
    upto = Window.partitionBy("d", "island").orderBy("p")
    whole = Window.partitionBy("d", "island")
    island = island.withColumn("words_upto", F.sum("words").over(upto)).withColumn("all", F.sum("words").over(whole)).where(F.col("all") >= min_words)
    active = cut(island.select("p", "d", "rank", (F.col("words_upto") - F.col("words")).alias("words_before"), "words_upto"))
    rounds = [active.select("p", "rank")]
    while True:
        last, length = rounds[-1], 1 << (len(rounds) - 1)
        pairs = last.join(last.select((F.col("p") - length).alias("p"), F.col("rank").alias("after")), "p").select("p", F.col("rank").alias("head"), "after")
        ranks = cut(_with_first(pairs, ["head", "after"], ranked=True).where("first is not null").select("p", "rank"))
        if ranks.isEmpty():
            drop_table(ranks)
            return active.drop("rank"), rounds
        rounds.append(ranks)


def _longest_earlier(active: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(p, length): lines shared with the longest-matching earlier suffix, where there is one."""
    # group: the first suffix of the LCP interval; own: a suffix that still extends, else an interval's first suffix, kept to represent it
    pool = active.select("p", F.lit(0).cast("long").alias("length"), F.lit(-1).cast("long").alias("group"), F.lit(True).alias("own"))
    for k in reversed(range(len(rounds))):
        ranks = rounds[k].select(F.col("p").alias("at"), F.col("rank").alias("next"))
        step = pool.withColumn("at", F.col("p") + F.col("length")).join(ranks, "at", "left").drop("at")
        step = _with_first(step, ["next", "group", "length"])

        def state(length, group, own):
            return F.struct(F.col("p").alias("p"), length.cast("long").alias("length"), group.alias("group"), own.alias("own"))

        longer, stays = F.col("length") + (1 << k), state(F.col("length"), F.col("group"), F.col("own"))
        moved = state(longer, F.col("first"), F.col("own"))
        represents = state(longer, F.col("first"), F.lit(False))
        states = F.when(F.col("first").isNull(), F.array(stays)).when(F.col("p") > F.col("first"), F.array(moved)).otherwise(F.array(stays, represents))
        pool = cut(step.select(F.explode(states).alias("s")).select("s.*"))
    return pool.where("own and length > 0").select("p", "length")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, n_lines, n_words, runs for each distinct (doc_id, text): the runs [first, last] of its first row that copy earlier lines."""
    lines, rows = _lines(docs)
    active, rounds = _rounds(lines, min_words)
    longest = _longest_earlier(active, rounds)
    ends = active.select(F.col("p").alias("end"), F.col("words_upto"))
    found = longest.withColumn("end", F.col("p") + F.col("length") - 1).join(ends, "end").join(active.select("p", "d", "words_before"), "p")
    found = found.where(F.col("words_upto") - F.col("words_before") >= min_words).select("p", "d", "end")
    # lines that some found run covers, joined to maximal runs
    runs = _merged(found).groupBy("d").agg(F.array_sort(F.collect_list(F.struct((F.col("first") - F.col("d")).cast("int").alias("first"), (F.col("last") - F.col("d")).cast("int").alias("last")))).alias("runs"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    rows = rows.join(runs, "d", "left").withColumn("runs", F.coalesce("runs", none))
    return rows.groupBy("doc_id", "key").agg(F.min_by("runs", "d").alias("runs"), F.min("n_lines").alias("n_lines"), F.min("n_words").alias("n_words"))


def _merged(found: DataFrame) -> DataFrame:
    in_doc = Window.partitionBy("d").orderBy("p")
    reach = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(F.col("p") > reach + 1, F.lit(True)).cast("int"))
    return marked.withColumn("run", F.sum("new").over(in_doc)).groupBy("d", "run").agg(F.min("p").alias("first"), F.max("end").alias("last"))


def _row_key():
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b":"), F.col("key"))))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, runs, text for each row of docs: its lines less later copies of repeated runs."""
    found = repeated_runs(docs, min_words).select(_row_key().alias("row_key"), "runs", "n_lines", "n_words")
    # rows equal in doc_id and text travel once, with their number; all but one are later copies as a whole
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", text_key()).withColumn("row_key", _row_key())
    rows = rows.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    joined = rows.join(found, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    all_lines = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_lines") - 1).cast("int").alias("last")))
    runs = F.when((F.col("copy") > 1) & (F.col("n_words") >= min_words), all_lines).otherwise(F.col("runs"))
    out = joined.withColumn("runs", runs).withColumn("n_removed", F.aggregate("runs", F.lit(0), lambda n, r: n + r.last - r.first + 1))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("runs", lambda r: (i >= r.first) & (i <= r.last)))
    text = F.when(F.size("runs") == 0, F.col("text")).when(F.col("n_removed") == F.col("n_lines"), "").otherwise(F.array_join(kept, "\n"))
    return out.select("doc_id", F.col("n_lines").cast("int").alias("n_lines"), "n_removed", "runs", text.alias("text"))
