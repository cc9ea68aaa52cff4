"""URL filters: host-suffix and path-prefix expressions against hashed rules, DataFrame functions only.

A URL is expanded into every host suffix joined with every path prefix that a
rule could have. The expressions are equi-joined with the rules on a short
prefix of their SHA-256; survivors are confirmed on the full digest, and the
longest rule decides. Nothing but the expressions of different (host, path)
pairs is shuffled, so a hot host or a page repeated many times costs one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join uses.
SHORT = 8
#: Between host and path in what is hashed: neither has it, so a rule never fits another split of its text.
APART = "\n"
#: Most rules that are broadcast; they are counted.
FEW_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their text, full digest and short prefix.

    Hosts are lower-cased; null hosts or paths are dropped, a null verdict
    blocks. Of rules with one host and path, block wins.
    """
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy(F.concat(host, "path").alias("rule"), F.concat(host, F.lit(APART), "path").alias("split"), F.length("path").alias("path_chars"), F.size(F.split("host", "[.]")).alias("labels"), F.col("path").endswith("/").alias("whole"))
        .agg(F.max(F.coalesce("verdict", F.lit("block"))).alias("verdict"))
        .withColumn("digest", F.sha2("split", 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest rule text wins, and of equal texts block. A null
    url, or one without ``://``, has an empty host and path, fits no rule and
    gets ``default``. Repeated rows and null ids are kept as they are; an
    existing column called host, path, rule or verdict is replaced. Without
    rules every page gets ``default``.
    """
    ready = prepared(rules)
    bounds = ready.agg(
        F.count("*"), F.max("labels"), F.max("path_chars"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("path_chars"))))
    ).first()
    n_rules, most_labels, most_chars, odd = bounds[0], bounds[1] or 0, bounds[2] or 0, bounds[3] or []
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*(F.col(f"`{c}`") for c in keep), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", "[.]")
    n = F.size(labels)
    # suffixes of as many labels as any rule has, prefixes that end where a rule's could
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, most_labels)))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    head = F.substring("path", 1, max(1, most_chars))
    cuts = F.filter(F.sequence(F.lit(0), F.length(head)), lambda i: (i > 0) & (F.substring(head, i, F.lit(1)) == "/"))
    ends = F.array_union(cuts, F.filter(F.array(*map(F.lit, odd)).cast("array<int>"), lambda i: i <= F.length("path")))
    prefixes = F.transform(ends, lambda i: F.substring(F.col("path"), F.lit(1), i))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(APART), p))))
    probes = (
        parsed.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    known = ready.select("short", "digest", "rule", "verdict")
    best = (
        probes.join(F.broadcast(known) if n_rules <= FEW_RULES else known, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("chars"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best"))
        .select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("best.rule").alias("b_rule"), F.col("best.verdict").alias("b_verdict"))
    )
    names = {c: fresh(c, [*keep, "host", "path"]) for c in ("b_host", "b_path", "b_rule", "b_verdict", "b_key")}
    best = best.withColumnsRenamed(names)
    # pages without a host match nothing: each has a key of its own, so that they do not meet in one task
    key = F.when(F.col("host") == "", F.monotonically_increasing_id().cast("string")).otherwise(F.col("path"))
    return parsed.withColumn(names["b_key"], key).join(best, (F.col("host") == F.col(names["b_host"])) & (F.col(names["b_key"]) == F.col(names["b_path"])), "left").select(
        *(F.col(f"`{c}`") for c in keep), "host", "path", F.col(names["b_rule"]).alias("rule"), F.coalesce(F.col(names["b_verdict"]), F.lit(default)).alias("verdict")
    )
