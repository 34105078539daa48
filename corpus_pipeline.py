"""Corpus pipeline: five stages, each a training-data operator, over the documents table.

    quality          rows that the classifier rejects go
    near_duplicates  one row of each group of near duplicates stays
    decontamination  rows that hold a benchmark item go
    mixing           leaves of the domain-language-source tree give what their weights ask for
    sharding         the rest is placed into shards

A stage takes (spark, docs, sf_dir) and returns the rows that it keeps with the columns of
documents; the last returns the places of rows in shards.  Every stage runs on all rows that
the one before has kept.

Defined results, in all stages: extra columns are kept, whatever their names; rows that repeat are
judged each, and all but one go as near duplicates; null and empty texts count as one empty
text; rows with a null doc_id, language or source are judged like others; an empty table gives no rows.
In particular: quality gives an empty text the score of the classifier's bias, and keeps all rows if labels
are missing or of one class; near_duplicates keeps, of ties, the row of the smallest doc_id, then of the
least text hash; decontamination finds nothing in an empty text, and removes nothing if the benchmark is
empty; mixing takes or leaves rows of one doc_id together; sharding keeps equal texts together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import cut, read
from framelake.llm.op1_quality import accepted, fit
from framelake.llm.op4_decontamination import decontaminated
from framelake.llm.op5_sharding import shard_documents
from framelake.llm.op6_mixing import mix_sources
from framelake.llm.op7_jaccard_join import one_of_each_group

#: The pipeline reads no text twice, so the mixture takes four fifths of what the weights allow in one epoch.
MIX_EPOCHS = 1
MIX_SHARE = (4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row travels as one struct beside what mixing reads, as it returns columns of its own
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("_document"))
    mixed = mix_sources(rows, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return mixed.select(*[F.col("_document")[c].alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the classifier or the join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
