"""Phrase collocation mining: weighted n-gram counts, duckdb per hash bucket, parts looked up by joins.

Texts are cut into pieces; identical pieces of a language become one row with a multiplicity, so
a passage that many documents share is counted once.  Phrases of one length after another are
counted, weighted by multiplicity:

1. A task reduces its pieces to distinct phrases with sums (numpy over word numbers), so that
   even the most frequent phrase reaches the shuffle once for each block of a task.
2. The sums are dealt by hash of (language, phrase) to buckets.  In each bucket duckdb groups them
   within a memory limit and goes out of core beyond it, in Spark's own scratch folder of the
   executor (SPARK_LOCAL_DIRS); only that task reads it, so a lost executor costs a rerun.
3. Phrases under the least count go.  A phrase can't be more frequent than its parts, so a longer
   one is counted only where its parts may be frequent: tasks test them in a bit table of fixed size.
   A bit that two phrases share only lets more through, so no phrase is lost; with a full
   table all phrases are counted.

Each candidate then asks for the counts of its parts: requests (language, part) are joined with the
counts by their key, and what comes back is grouped by candidate.  Frequent parts, asked for by many
candidates, are left to the skew handling of Spark's joins, as counts are unique.  Of longer candidates only
the largest count for each inner phrase is sent.

Defined results: a null language counts as `und`, together with rows that say `und`; null and empty
texts have no words; very long pieces are pieces like others (one is held by one task at a time);
repeated rows count each; scores that tie go by count, then by phrase in byte order; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import tempfile
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAST = 30
LONGEST = 4
#: The first so many of each language are reported.
MOST = 2000
#: A longer candidate that has this share of a candidate's count takes its place.
CONTAINED = (80, 100)
#: Bits of the table of frequent parts (8 MB), whatever the corpus.
FILTER_BITS = 1 << 26
#: Bytes of pieces that a task reduces at once, and duckdb's memory in a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_MEMORY = "200MB"
#: Parts of a language that are ranked by themselves before the whole.
RANK_PARTS = 64

COUNTS = "lang string, phrase string, n long"


def pieces(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, piece, n): distinct pieces, lower-cased in A-Z, words apart by one blank, with multiplicities."""
    text = F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    apart = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    plain = apart.select("lang", F.btrim(F.regexp_replace("piece", r"[ \t]+", " "), F.lit(" ")).alias("piece"))
    return plain.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def n_words(phrase: str):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def _bit(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42) & (FILTER_BITS - 1)


def frequent_bits(counts: DataFrame) -> np.ndarray:
    """A table of FILTER_BITS bits with those of all phrases of a table set; rows that reach the driver: one for each 64 bits at most."""
    place = F.xxhash64(F.concat("lang", F.lit("\0"), "phrase")).bitwiseAND(FILTER_BITS - 1)
    words = counts.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def block_phrases(langs, texts, n: np.ndarray, lengths: tuple[int, int], filters: dict[int, np.ndarray]) -> Iterator[tuple]:
    """(langs, phrases, sums) of the distinct phrases of a block of pieces, for each of the lengths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    apart = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(apart).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = apart.flatten().dictionary_encode()
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    spoken = langs.dictionary_encode()
    weight, piece_end = np.repeat(n, sizes), np.repeat(np.cumsum(sizes), sizes)
    lang = np.repeat(spoken.indices.to_numpy(), sizes)
    at, key = np.arange(len(word)), lang.astype(np.int64) * max(1, len(words)) + word
    number = np.full(len(word) + 1, -1, np.int64)  # which distinct phrase begins at a place
    for k in range(1, lengths[1] + 1):
        if k > 1:
            at = at[(number[at] >= 0) & (at + k <= piece_end[at])]
            at = at[number[at + 1] >= 0]
            key = number[at] * (number.max() + 1) + number[at + 1]
        if not len(at):
            return
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        first = at[order[starts]]
        which = np.empty(len(at), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
        phrases = words.take(pa.array(word[first]))
        if k > 1:
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(word[first + j])) for j in range(k)], " ")
        own = spoken.dictionary.take(pa.array(lang[first]))
        if k >= lengths[0]:
            yield own, phrases, np.add.reduceat(weight[at][order], starts)
        number[:] = -1
        if k in filters:
            keys = pc.binary_join_element_wise(own, phrases, "\0").cast(pa.binary()).to_pylist()
            bits = np.fromiter(map(_bit, keys), np.int64, len(keys))
            passes = (filters[k][bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0
            which = np.where(passes[which], which, -1)
        number[at] = which


def phrase_counts(table: DataFrame, lengths: tuple[int, int], filters: dict[int, np.ndarray], least: int = LEAST) -> DataFrame:
    """(lang, phrase, n) of the phrases of so many words that occur `least` times or more; filters hold bits of frequent shorter ones."""
    import pyarrow as pa

    spark = table.sparkSession
    held = spark.sparkContext.broadcast(filters)  # of a fixed size
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(block).combine_chunks()
            columns = [t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in ("lang", "piece", "n")]
            for langs, phrases, sums in block_phrases(columns[0], columns[1], columns[2].to_numpy(), lengths, held.value):
                whole = pa.RecordBatch.from_arrays([langs, phrases, pa.array(sums)], schema=schema)
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

        for b in batches:
            step = max(1, int(b.num_rows * BLOCK_BYTES / max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                block.append(b.slice(at, step))
                size += block[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield from flush()
                    block, size = [], 0
        if block:
            yield from flush()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(dir=scratch) as folder:
            settings = {"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}
            with duckdb.connect(config=settings) as bucket:
                bucket.register("parts", pa.RecordBatchReader.from_batches(schema, batches))
                found = bucket.execute(f"select lang, phrase, sum(n)::bigint as n from parts group by all having sum(n) >= {int(least)}")
                for b in found.to_arrow_reader(50_000):
                    yield b.cast(schema)

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table.mapInArrow(reduced, COUNTS).repartition(buckets, "lang", "phrase").mapInArrow(grouped, COUNTS)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all frequent phrases of 1 to `longest` words, and (lang, n): words of each language."""
    table = cut(pieces(docs))
    words = cut(phrase_counts(table, (1, 1), {}, least))
    filters = {1: frequent_bits(words)}
    pairs = cut(phrase_counts(table, (2, 2), filters, least)) if longest > 1 else words.limit(0)
    found = words.unionByName(pairs)
    if longest > 2:
        found = found.unionByName(cut(phrase_counts(table, (3, longest), filters | {2: frequent_bits(pairs)}, least)))
    total = table.groupBy("lang").agg(F.sum(F.col("n") * n_words("piece")).alias("n"))
    return found, total


def _first_words(k) -> F.Column:
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def weakest_cuts(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more, by the cut that scores lowest, the first of equals."""
    candidates = found.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("n", "a").withColumn("words", n_words("phrase"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    asked = cuts.select("lang", "phrase", "a", "k", _first_words(F.col("k")).alias("left"), _first_words(F.col("k") - F.col("words")).alias("right"))
    lefts, rights = (found.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])) for side in ("left", "right"))
    answered = asked.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = answered.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_contained(scored: DataFrame, share: tuple[int, int] = CONTAINED) -> DataFrame:
    """Candidates without those whose words lie in a longer candidate that has at least the share of their count."""
    longer = scored.select("lang", "phrase", "a", n_words("phrase").alias("words")).where("words > 2")
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    places = sizes.select("*", F.explode(F.sequence(F.col("size"), F.col("words"))).alias("end"))
    inner = F.call_function("substring_index", _first_words(F.col("end")), F.lit(" "), -F.col("size"))
    held = places.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    stays = F.col("held").isNull() | (big("held") * share[1] < big("a") * share[0])
    return scored.join(held, ["lang", "phrase"], "left").where(stays).drop("held")


def ranked(kept: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` of each language, numbered; each of RANK_PARTS parts of a language is ranked before the whole."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `most` phrases of each language."""
    found, total = frequent_phrases(docs, least, longest)
    best = ranked(not_contained(cut(weakest_cuts(found))), most)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
