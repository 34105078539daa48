"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .op10_lm_scoring import score_documents as lm_score_documents
from .op11_pieces import piece_digests
from .op12_phrases import mine_phrases
from .op13_search import search_documents
from .op1_quality import fit, score_documents
from .op2_url_filters import filter_urls
from .op3_fingerprints import fingerprint_documents
from .op4_decontamination import leaks
from .op5_sharding import shard_documents
from .op6_mixing import mix_sources
from .op7_jaccard_join import near_duplicates
from .op8_line_dedup import without_repeats
from .op9_token_counts import count_tokens


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("group_key", F.lower(F.hex("root"))).drop("key", "root")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "runs", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score_documents(read(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # at the top of the repository

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_url_filters,
        op3_fingerprints,
        op4_decontamination,
        op5_sharding,
        op6_mixing,
        op7_jaccard_join,
        op8_line_dedup,
        op9_token_counts,
        op10_lm_scoring,
        op11_pieces,
        op12_phrases,
        op13_search,
        pipeline,
    )
}
