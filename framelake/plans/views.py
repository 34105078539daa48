"""Record views over the driver's tables, for Spark and (same names) for DuckDB.

They stand in for bitstream records: they exercise the computations, not codec conformance.

    blk   embeddings as 8x8 blocks of samples 0..255, label = segment
    pkt   events as packets of a stream (user) in coding order, with bits
    obu   lineitem as units of a stream (order), with size, type and layer
    hdr   orders as headers of an id (customer), seen at (date, key)
    bytes documents as UTF-8 bytes
    turn  conversations as units with a phase from the role
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 256).cast("int") + 128))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", sample).alias("x"))


def pkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("n"), "event_type", F.round(F.col("value") * 100).cast("long").alias("bits"), "event_id")


def obu(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("stream"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.floor("l_extendedprice").cast("long").alias("size"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"),
        (F.col("l_suppkey") % 4).cast("int").alias("layer"),
        F.floor("l_quantity").cast("long").alias("qty"),
        F.col("l_partkey").alias("part"),
    )


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("header_id"), F.col("o_orderkey").alias("seen_at"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("status"))


def turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), F.col("turn").alias("pos"), "role", phase.alias("phase"))


#: The same views as DuckDB text, put before a query as common table expressions.
SQL = {
    "blk": "blk as (select vec_id, label, [least(255, greatest(0, floor(e::double * 256)::int + 128)) for e in embedding] as x from embeddings)",
    "px": "px as (select vec_id, label, i, i // 8 as r, i % 8 as c, x[i + 1] as v from blk, (select unnest(range(64))::int as i))",
    "pkt": "pkt as (select user_id as stream, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as n, event_type, round(value * 100)::bigint as bits, event_id from events)",
    "obu": "obu as (select l_orderkey as stream, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::bigint as idx, floor(l_extendedprice)::bigint as size, l_returnflag || l_linestatus as kind, (l_suppkey % 4)::int as layer, floor(l_quantity)::bigint as qty, l_partkey as part from lineitem)",
    "hdr": "hdr as (select o_custkey as header_id, o_orderkey as seen_at, o_orderpriority as profile, o_orderstatus as status from orders)",
    "turn_": "turn_ as (select conv_id as unit, turn as pos, role, case role when 'system' then 0 when 'user' then 1 else 2 end as phase from conversations)",
}


def with_views(names: str, body: str) -> str:
    """Query text with the named views (space-separated, dependencies first)."""
    return "with recursive " + ", ".join(SQL[n] for n in names.split()) + "\n" + body
