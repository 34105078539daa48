"""Rule engine: predicates with stable ids and severities over records.

A rule is a Column predicate; all rules are evaluated in one projection and exploded, so any
number of rules costs one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"info": 0, "warning": 1, "error": 2}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    summary: str
    fails: Column


def findings(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """keep columns, rule_id, severity: one row for each rule that a record breaks, rules in the order given."""
    hits = F.filter(F.array(*[F.when(r.fails, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias("f")).select(*keep, "f.*")


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def severity_summary(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])


def accepted(found: DataFrame, key: str, strict: bool) -> DataFrame:
    """Whether each stream with findings passes: errors fail, in strict mode warnings too."""
    rank = F.lit(0)
    for s, r in RANK.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    limit = RANK["warning"] if strict else RANK["error"]
    return found.groupBy(key).agg((F.max(rank) < limit).alias("accepted"))


def first_findings(found: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n findings of each stream and how many more there are: a report's cap is the feature."""
    w = Window.partitionBy(key).orderBy(*order)
    shown = found.withColumn("place", F.row_number().over(w)).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy(key)) - n))
    return shown.where(F.col("place") <= n)


def explain(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings with the summaries of their rules; the rule table has a row for each rule written here."""
    spark = found.sparkSession
    table = spark.createDataFrame([(r.rule_id, r.summary) for r in rules], "rule_id string, summary string")
    return found.join(F.broadcast(table), "rule_id", "left")


def set_difference(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Error rule ids that are missing or unexpected, order and number aside."""
    got = found.where("severity = 'error'").select("rule_id").distinct()
    missing = expected.select("rule_id").exceptAll(got).withColumn("side", F.lit("missing"))
    return missing.unionByName(got.exceptAll(expected.select("rule_id")).withColumn("side", F.lit("unexpected")))


def suggestions(asked: DataFrame, registry: DataFrame, most: int = 8) -> DataFrame:
    """(asked, rule_id): for ids that may be misspelt the first registered ids of their namespace, else of their first letter.

    The cap is a report's feature.
    """
    space = F.substring_index("asked", "/", 1) == F.substring_index("rule_id", "/", 1)
    letter = F.substring("asked", 1, 1) == F.substring("rule_id", 1, 1)
    asked = asked.select("asked").distinct()

    def first(hits: DataFrame) -> DataFrame:
        return hits.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("rule_id"))).where(F.col("place") <= most).drop("place")

    near = first(asked.join(registry, space))
    return near.unionByName(first(asked.join(near.select("asked").distinct(), "asked", "left_anti").join(registry, letter)))


def registry_drift(emitted: DataFrame, registered: DataFrame) -> DataFrame:
    """(rule_id, side): ids that are emitted but not registered, or registered but never emitted."""
    e, r = (d.select("rule_id").distinct().withColumn(n, F.lit(True)) for d, n in ((emitted, "emitted"), (registered, "registered")))
    both = e.join(r, "rule_id", "full").where("emitted is null or registered is null")
    return both.select("rule_id", F.when(F.col("emitted").isNull(), "never emitted").otherwise("not registered").alias("side"))


def manifest_coverage(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of files (path, sha256) against a manifest (path, sha256): unlisted, missing, listed twice, changed or ok."""
    listed = manifest.groupBy("path").agg(F.count("*").alias("times"), F.min("sha256").alias("expected"))
    both = files.join(listed, "path", "full")
    state = F.when(F.col("times").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("times") > 1, "listed twice").when(F.col("sha256") != F.col("expected"), "changed").otherwise("ok")
    return both.select("path", state.alias("state"))


def merged(found: DataFrame, context: DataFrame, unit: list[str]) -> DataFrame:
    """Findings of the stateful context, then those of the stateless rules, numbered within each unit (emit_seq)."""
    both = context.withColumn("origin", F.lit(0)).unionByName(found.withColumn("origin", F.lit(1)))
    return both.withColumn("emit_seq", F.row_number().over(Window.partitionBy(*unit).orderBy("origin", "rule_id"))).drop("origin")


def text_report(found: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """(key, report): a stream's first findings, what was left out, counts and verdict as text lines."""
    shown = first_findings(found, key, order, most).select(key, "place", F.concat(F.col("severity"), F.lit(": "), F.col("rule_id"), *[x for c in order if c != "rule_id" for x in (F.lit(" at "), F.col(c).cast("string"))]).alias("line"))
    lines = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))  # at most `most` rows a stream
    counts = found.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")], F.count("*").alias("n"))
    left_out = F.when(F.col("n") > most, F.format_string(f"... %d more diagnostic(s) not shown (--max-diagnostics {most})\n", F.col("n") - most)).otherwise("")
    verdict = F.when(F.col("error") == 0, "conformant: no errors found\n").otherwise("NOT conformant\n")
    summary = F.format_string("%d error(s), %d warning(s), %d info\n", "error", "warning", "info")
    text = F.concat(F.array_join(F.transform("x", lambda x: F.concat(x["line"], F.lit("\n"))), ""), left_out, summary, verdict)
    return counts.join(lines, key).select(key, text.alias("report"))
