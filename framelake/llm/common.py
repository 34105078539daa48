"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a shingle and the similarity from which two texts are near duplicates.
SHINGLE_WORDS = 5
NEAR = 0.8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is missing, a session on one machine (master local) takes a temporary folder
    of its own; on a cluster no such folder would be shared, so that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder.

    This ends the lineage: what follows reads files that any executor can reach, so a lost
    executor costs its own tasks only, and ids made by a scan or a sort stay as they are.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str, values: Iterable[int]) -> dict[int, DataFrame]:
    """The rows of df with each of these values of a column, without it, each as a table of its own like cut()'s."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for v in values:
        own = f"{path}/{column}={v}"
        out[v] = spark.read.schema(schema).parquet(own) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(own)) else spark.createDataFrame([], schema)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each query are deleted as soon as the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text"):
    """128 bits that stand for a text (null: empty); equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(text_or_empty(name).cast("binary"), 256), 1, 32))


def numbered(df: DataFrame, *order: str, within: str | None = None) -> DataFrame:
    """df with `row_no`, gapless from 0 in the given order, counted separately for each value of `within`.

    Rows are range-partitioned and sorted, never gathered: a small table with a row for each
    partition (and value of `within`) turns places in a partition into places in the whole.
    Rows that tie in all order columns are numbered in an arbitrary but fixed order.
    """
    keys = ([within] if within else []) + list(order)
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = cut(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), 33)
    group = F.col(within) if within else F.lit(0)
    sizes = local.groupBy(part.alias("_part"), group.alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_start")
    return (
        local.withColumn("_part", part)
        .withColumn("_group", group)
        .join(starts, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
        .withColumn("row_no", F.col("_at") + F.col("_start"))
        .drop("_part", "_group", "_p", "_g", "_start", "_at")
    )


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash for each run of so many words, in text order; a shorter text is one run, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : i + n])
    return out


def grouped(batches: Iterator, key: str) -> Iterator:
    """(key, pandas rows) for each run of equal keys in a sorted partition, across Arrow batches."""
    import pandas as pd

    held, held_key = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *ends.tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if held and keys[a] != held_key:
                yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held_key = keys[a]
            held.append(pdf.iloc[a:b])
    if held:
        yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table counted to have at most so many (narrow) rows; else the table as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def in_blocks(batches: Iterator, chars: int = 4_000_000) -> Iterator:
    """Arrow batches cut into slices of about so many bytes, so that memory doesn't depend on the batch size."""
    for batch in batches:
        step = max(1, int(batch.num_rows * chars / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
