"""URL filters: pattern rules fetched through their rarest literal token.

A rule is a host and a path prefix (`example.net/en/`) or a wildcard pattern over the whole
URL (`*casino*`: `*` is any run, `^` a separator or the end).  Each rule is reduced to one
regular expression and filed under the rarest of its literal tokens, as counted over the
URLs to be judged.  A URL's tokens fetch candidate rules by an equi-join, and regular
expressions run for those candidates only, in the order of rules, so that each is compiled about once
a task.  Rules are a table of any size (or a few `Rule`s); everything is DataFrame work.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and
gets the default verdict; a URL with `://` and an empty host is judged by the patterns; rules that
are null or repeat count once; of no rules, the default verdict is given; a very long URL is judged whole;
repeated rows are each judged; other columns are kept as they are,
also if they are called `host`, `path`, `rule` or `verdict` (the operator's columns replace them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`kind` is host (host and path prefix) or pattern; `verdict` is allow or block."""

    text: str
    verdict: str
    kind: str = "host"


#: The rules of the query's contract.
HOST_RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
#: What the method itself blocks where no host rule fits.
PATTERN_RULES = (
    Rule("://*spam-farm.", "block", "pattern"),
    Rule("://*cheap-pills.", "block", "pattern"),
    Rule("://*free-bets.", "block", "pattern"),
    Rule("://*adult-x.", "block", "pattern"),
    Rule("://*.casino^", "block", "pattern"),
    Rule("/adserver/", "block", "pattern"),
)
#: Splits host and URL into tokens; a token is a maximal run of other characters.
SEPARATORS = r"[^a-z0-9]+"


def host_and_path(url):
    """The host is lower-cased in A-Z only; host and path are empty where there is no `://`."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    found = url.isNotNull() & url.contains("://")
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, host).otherwise(""), F.when(found, F.regexp_extract(url, whole, 2)).otherwise("")


def rules_frame(spark, host_rules, pattern_rules) -> DataFrame:
    """(rule, verdict, kind) of rules given as tuples of Rule or as tables (rule, verdict)."""
    parts = []
    for kind, rules in (("host", host_rules), ("pattern", pattern_rules)):
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame([(r.text, r.verdict) for r in rules], "rule string, verdict string")
        parts.append(rules.select("rule", "verdict", F.lit(kind).alias("kind")))
    return parts[0].unionByName(parts[1]).where("rule is not null").groupBy("rule", "kind").agg(F.min("verdict").alias("verdict"))


def compiled(rules: DataFrame) -> DataFrame:
    """rules with `length`, `regex` and `tokens`.

    A regular expression runs over `host`+newline+`path` (host rules) or the lower-cased URL.  Only
    tokens that a fitting URL must hold as whole tokens count: one at an open end of the rule or beside
    `*` may go on in the URL, so it is left out.  A rule without tokens is filed under the empty one.
    """
    host = F.substring_index("rule", "/", 1)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    escaped = lambda c: F.regexp_replace(c, r"([!-/:-@\[-`{-~])", r"\\$1")
    pattern = F.replace(F.replace(escaped(F.col("rule")), F.lit(r"\*"), F.lit(".*")), F.lit(r"\^"), F.lit(r"(?:[^a-z0-9_.%-]|$)"))
    whole = lambda c, beside: F.regexp_extract_all(c, F.lit(f"(?<=[^A-Za-z0-9{beside}])[a-z0-9]+(?=[^A-Za-z0-9{beside}])"), F.lit(0))
    is_host = F.col("kind") == "host"
    tokens = F.when(is_host, F.concat(F.split(host, SEPARATORS), whole(path, ""))).otherwise(whole(F.col("rule"), "*"))
    tokens = F.filter(F.array_distinct(tokens), lambda t: t != "")
    regex = F.when(is_host, F.concat(F.lit(r"(?s)^(?:.*\.)?"), escaped(host), F.lit(r"\n"), escaped(path))).otherwise(F.concat(F.lit("(?s)"), pattern))
    return rules.select("rule", "verdict", "kind", F.length("rule").alias("length"), regex.alias("regex"), F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(tokens).alias("tokens"))


def rule_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, verdict, kind, length, regex, token: the rarest of the rule's tokens among the URLs, or '' if it has none."""
    table = compiled(rules).withColumn("token", F.explode("tokens")).drop("tokens")
    counts = urls.select(F.explode("tokens").alias("token")).join(table.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), (-F.length("token")).alias("n"), "token")
    chosen = table.join(counts, "token", "left").groupBy("rule", "verdict", "kind", "length", "regex").agg(F.min(rarest).alias("best"))
    return chosen.select("rule", "verdict", "kind", "length", "regex", F.col("best.token").alias("token"))


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[Rule, ...] | DataFrame = HOST_RULES,
    pattern_rules: tuple[Rule, ...] | DataFrame = PATTERN_RULES,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """pages with host, path, rule, pattern_rule, verdict; rules as tuples or as tables (rule, verdict).

    The longest fitting host rule decides; else a blocking pattern rule; else the default.
    Of rules equally long the first in text order wins.
    """
    # the row travels as one struct, so that no column of pages can clash with the operator's
    host, path = host_and_path(F.col(url_column))
    judged = pages.select(F.struct(*pages.columns).alias("_row"), F.col(id_column).alias("id"), F.col(url_column).alias("page_url"), host.alias("host"), path.alias("path"))
    urls = (
        judged.where(F.col("page_url").contains("://"))
        .select(F.col("id").alias("_id"), F.col("page_url").alias("_url"), "host", "path")
        .withColumn("lower", F.lower("_url"))
        .withColumn("tokens", F.array_distinct(F.concat(F.split(F.concat("host", F.lit("/"), F.lower("path")), SEPARATORS), F.split("lower", SEPARATORS), F.array(F.lit("")))))
    )
    rules = rule_table(urls, rules_frame(pages.sparkSession, host_rules, pattern_rules))
    candidates = urls.withColumn("token", F.explode("tokens")).drop("tokens").join(rules, "token").sortWithinPartitions("rule")
    subject = F.when(F.col("kind") == "host", F.concat("host", F.lit("\n"), "path")).otherwise(F.col("lower"))
    hits = candidates.where(F.regexp_instr(subject, F.col("regex")) > 0)  # keeps the last compiled expression

    def first(kind: str):
        # longest rule first, then text order: min over (-length, rule)
        return F.min(F.when(F.col("kind") == kind, F.struct(-F.col("length"), F.col("rule"), F.col("verdict"))))

    best = hits.groupBy("_id", "_url").agg(first("host").alias("_host_hit"), first("pattern").alias("_pattern_hit"))
    # host and path rows without a hit keep null; the key is (id, url), so repeated rows are all answered
    out = judged.join(best, F.col("id").eqNullSafe(F.col("_id")) & F.col("page_url").eqNullSafe(F.col("_url")), "left")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern_rule", "verdict")]
    return out.select(
        *[F.col("_row")[c].alias(c) for c in own],
        "host",
        "path",
        F.col("_host_hit.rule").alias("rule"),
        F.col("_pattern_hit.rule").alias("pattern_rule"),
        F.coalesce("_host_hit.verdict", "_pattern_hit.verdict", F.lit(default)).alias("verdict"),
    )
