"""URL rules looked up by hash prefix: host-suffix and path-prefix expressions, an equi-join, then full digests and precedence."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan.llm import scratch

#: Hexadecimal digits of the short hash that the join uses.
PREFIX_DIGITS = 8
DEFAULT = "allow"


@dataclass(frozen=True)
class UrlRule:
    """verdict ('allow' or 'block') for host and its subdomains, where the URL's path starts with path."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """path up to its last '/'."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = DEFAULT, url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null) and verdict (its, else default).

    Of the rules that fit, the longest (host and path together) decides, then the longest host, then block before allow.
    A null URL, or one without '://', has host and path '' and the default verdict. Columns of pages with these four
    names are replaced. Work and rows expanded depend on the rules' depth, not the URL's: no rule fits an expression of
    more labels or folders than it has, and URLs that agree as far as any rule reads them are expanded once.
    """
    spark = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = max(r.host.count(".") + 1 for r in rules)
    folders, reach = max(r.path.count("/") for r in rules), max(len(r.path) for r in rules)
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, rule_host string, rule_path string")
    table = table.withColumn("digest", F.sha2(F.concat("rule_host", F.lit("\n"), _folder(F.col("rule_path"))), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    scope = {"scope_host": F.substring_index("host", ".", -labels), "scope_path": F.substring("path", 1, reach)}
    scopes = pages.groupBy(*(c.alias(n) for n, c in scope.items())).agg(F.count("*").alias("n_pages"))
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(F.split("scope_host", r"\.")))), lambda n: F.call_function("substring_index", F.col("scope_host"), F.lit("."), -n))
    depth = F.least(F.lit(folders), F.size(F.split("scope_path", "/")) - 1)
    paths = F.transform(F.sequence(F.lit(0), depth), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("scope_path"), F.lit("/"), n), F.lit("/"))))
    expressions = scopes.withColumn("h", F.explode(hosts)).withColumn("p", F.explode(F.array_distinct(paths)))
    expressions = expressions.withColumn("full", F.sha2(F.concat("h", F.lit("\n"), "p"), 256)).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    rules_side = F.broadcast(table) if len(rules) <= scratch.BROADCAST_ROWS else table
    met = expressions.join(rules_side, "short").where("full = digest and startswith(scope_path, rule_path)")
    order = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("host_length"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = scratch.table(met.groupBy("scope_host", "scope_path").agg(F.max(order).alias("best"), F.first("n_pages").alias("n_pages")))
    kept = [c for c in pages.columns if c not in ("rule", "verdict")]
    keyed = pages.select(*kept).withColumns(scope)
    return scratch.join_counted(keyed, best, ["scope_host", "scope_path"], "n_pages", "left").select(*kept, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
