"""Order of a graph of references by dependency, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.datasource import working_dir


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage."""
    path = working_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def levels(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """nodes (keys, node) with `level`: 0 without references, else one more than the highest of its references; null on a cycle and behind one.

    edges: keys, src, dst (dst refers to src); edges from unknown nodes are ignored, repeated ones count once.
    Each round settles the nodes whose references are settled and sends them, added up by dst, to
    those that wait; there are as many rounds as levels, each over the edges of one level only.
    """
    known = nodes.select(*keys, node).distinct()
    ends = edges.select(*keys, "src", "dst").distinct().join(known.withColumnRenamed(node, "src"), [*keys, "src"], "left_semi")
    ends = _written(ends)
    waits = ends.groupBy(*keys, F.col("dst").alias(node)).agg(F.count("*").alias("_open"))
    state = _written(known.join(waits, [*keys, node], "left").select(*keys, node, F.coalesce("_open", F.lit(0)).alias("_open"), F.lit(None).cast("int").alias("level")))
    done: list[DataFrame] = []
    for level in range(1 << 20):
        ready = _written(state.where("_open = 0").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done.append(ready)
        sent = ends.join(ready.select(*keys, F.col(node).alias("src")), [*keys, "src"], "left_semi").groupBy(*keys, F.col("dst").alias(node)).agg(F.count("*").alias("_got"))
        state = _written(state.where("_open > 0").join(sent, [*keys, node], "left").select(*keys, node, (F.col("_open") - F.coalesce("_got", F.lit(0))).alias("_open"), "level"))
    out = state
    for ready in done:
        out = out.unionByName(ready)
    return out.drop("_open")
