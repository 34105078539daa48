"""Mixing sources to target weights: budgets down a domain-language-source tree.

Weights are propagated from the root: a node's budget is dealt to its children by weight, a
child takes no more than the tokens below it times the epochs allowed, and what it leaves is
dealt again to its siblings; only what they can't take either is missed by the parent, whose
own siblings have it already (a parent's limit is the sum of its children's).  A leaf then
reads whole epochs and a prefix of the next one; each epoch is the leaf in the order of a
seeded hash.  The prefix ends before the row that would exceed the leaf's budget.

The prefix is found without sorting a leaf: sums over 4,096 ranges of the hash show the range
that the end falls into, its 4,096 parts the part, and only that part is sorted.

Defined results: null language or source is the empty name; a null or empty text has one
token; rows that tie in the hash (same doc_id) are taken or left together; an empty table
gives no rows; a very long text is one row of its tokens; extra columns are kept, but for `domain`, `tokens` and
`epoch`, which the operator's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, text_or_empty

SEED = 17
#: Epochs that a leaf may be read, and the budget as a share (num, den) of all tokens.
MAX_EPOCHS = 4
BUDGET_SHARE = (4, 5)
#: Relative weights; names that aren't listed weigh 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 2}
HASH_BITS = 60


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number at the end of a source's name; `other` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.when(number != "", number).cast("int") % 4).cast("string")))


def tokens_of(text: Column) -> Column:
    """About four bytes a token, one at least."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4)).cast("long")


def epoch_hash(epoch: Column, seed: int) -> Column:
    """60 bits that order a leaf's rows in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def dealt(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (name, cap, weight, parent_budget) with `budget`: shares by weight, up to cap, shortages dealt again to siblings.

    In ascending order of cap/weight the children that are full form a prefix: a child is
    full if its cap is at most its share of what the smaller ones leave.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    return (
        nodes.withColumn("_w", F.sum("weight").over(siblings))
        .withColumn("_w_before", F.coalesce(F.sum("weight").over(before), none))
        .withColumn("_cap_before", F.coalesce(F.sum("cap").over(before), none))
        .withColumn("_full", F.col("cap") * (F.col("_w") - F.col("_w_before")) <= F.col("weight") * (F.col("parent_budget") - F.col("_cap_before")))
        .withColumn("_left", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(siblings), none))
        .withColumn("_w_left", F.col("_w") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(siblings), none))
        .withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("weight * _left div greatest(_w_left, 1)")))
        .drop("_w", "_w_before", "_cap_before", "_full", "_left", "_w_left")
    )


def leaf_budgets(rows: DataFrame, share: tuple[int, int], max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """_domain, _lang, _source, supply, budget."""
    leaves = rows.groupBy("_domain", "_lang", "_source").agg(F.sum("_tokens").alias("supply"))
    leaves = cut(leaves.withColumn("cap", F.col("supply") * max_epochs))
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    whole = Window.partitionBy(F.lit(0))  # a row for each domain
    domains = domains.withColumn("parent_budget", F.least(F.sum("cap").over(whole), F.expr(f"sum(supply) over (partition by 0) * {share[0]} div {share[1]}")))
    domains = dealt(domains.withColumn("weight", weight_of(F.col("_domain"), weights[0])), [], "_domain")
    langs = langs.join(domains.select("_domain", F.col("budget").alias("parent_budget")), "_domain")
    langs = dealt(langs.withColumn("weight", weight_of(F.col("_lang"), weights[1])), ["_domain"], "_lang")
    leaves = leaves.join(langs.select("_domain", "_lang", F.col("budget").alias("parent_budget")), ["_domain", "_lang"])
    leaves = dealt(leaves.withColumn("weight", weight_of(F.col("_source"), weights[2])), ["_domain", "_lang"], "_source")
    return leaves.select("_domain", "_lang", "_source", "supply", "budget")


def mix_sources(
    docs: DataFrame,
    budget_share: tuple[int, int] = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
    domain: Column | None = None,
) -> DataFrame:
    """The rows of docs that the mixture reads, once for each epoch, with `domain`, `tokens` and `epoch`."""
    leaf = ["_domain", "_lang", "_source"]
    # the row travels as one struct, so that no column of docs can clash with the operator's
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        "doc_id",
        (domain if domain is not None else domain_of(F.col("source"))).alias("_domain"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        tokens_of(text_or_empty()).alias("_tokens"),
    )
    plan = cut(
        leaf_budgets(rows, budget_share, max_epochs, weights)
        .withColumn("full", F.expr("budget div supply").cast("int"))
        .withColumn("rest", F.expr("budget % supply"))
        .drop("supply", "budget")
    )
    partial = cut(rows.select(*leaf, "doc_id", "_tokens").join(broadcast_if_small(plan), leaf).withColumn("h", epoch_hash(F.col("full"), seed)).select(*leaf, "rest", "h", "_tokens"))
    for shift in (HASH_BITS - 12, HASH_BITS - 24):
        # sums over ranges of the hash; the first range whose running sum exceeds the rest holds the end
        cells = partial.groupBy(*leaf, "rest", F.shiftright("h", shift).alias("cell")).agg(F.sum("_tokens").alias("sum"))
        run = Window.partitionBy(*leaf).orderBy("cell")
        ends = cells.withColumn("upto", F.sum("sum").over(run)).where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("sum")).alias("rest"))).alias("end"))
        ends = cut(ends.select(*leaf, F.col("end.cell").alias("cell"), F.col("end.rest").alias("new_rest")))
        partial = partial.withColumn("cell", F.shiftright("h", shift)).join(broadcast_if_small(ends), [*leaf, "cell"]).select(*leaf, F.col("new_rest").alias("rest"), "h", "_tokens")
    same = partial.groupBy(*leaf, "rest", "h").agg(F.sum("_tokens").alias("sum"))
    run = Window.partitionBy(*leaf).orderBy("h")
    limits = same.withColumn("upto", F.sum("sum").over(run)).where("upto > rest").groupBy(*leaf).agg(F.min("h").alias("limit"))
    plan = cut(plan.join(limits, leaf, "left").withColumn("limit", F.coalesce("limit", F.lit(1 << HASH_BITS))).drop("rest"))
    read = rows.join(broadcast_if_small(plan), leaf).withColumn("_h", epoch_hash(F.col("full"), seed))
    epochs = F.when(F.col("_h") < F.col("limit"), F.sequence(F.lit(0), F.col("full"))).when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1))
    own = [c for c in docs.columns if c not in ("domain", "tokens", "epoch")]
    return read.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_domain").alias("domain"), F.col("_tokens").alias("tokens"), F.explode(epochs).alias("epoch"))
