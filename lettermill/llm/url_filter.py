"""URL filters by host-suffix and path-prefix expressions.

A rule is a host and the start of a path. Its anchor is the host and the path up to its last
slash. Each URL is expanded into the anchors that could fit it: the endings of its host at dots,
each with the beginnings of its path at slashes. URLs and rules meet in an equi-join on a short
prefix of the anchor's hash; the full digest and the rule's whole path are compared after that.
Of the rules that fit, the longest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: The rules of the query's contract, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PREFIX_HEX = 8


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no '://'."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def anchors(rules: DataFrame) -> DataFrame:
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    at = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    out = rules.select(host.alias("rule_host"), path.alias("rule_path"), "verdict", _digest(host, at).alias("rule_digest"), F.size(F.split(host, r"\.")).alias("labels"), (F.length(at) - F.length(F.replace(at, F.lit("/"), F.lit("")))).alias("slashes"))
    return out.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))


def expand(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """A row for each expression of (host, path). labels and slashes: the most that any rule has,
    for no longer expression can meet a rule; so long URLs don't give long expansions."""
    names = F.split("host", r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
        lambda n: F.concat_ws(".", F.slice(names, F.size(names) - n + 1, n)),
    )
    pieces = F.split("path", "/")
    starts = F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/"))),
    )
    out = urls.select("*", F.explode(endings).alias("ending")).select("*", F.explode(starts).alias("start"))
    out = out.withColumn("digest", _digest(F.col("ending"), F.col("start")))
    return out.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that counts, else null), verdict.

    A null URL, or one without '://', has an empty host and path and the default verdict. Of two
    rules of one length, the blocking one counts, then the last by name. Repeated rows are each
    judged. Columns of pages with these names are replaced; others stay. Empty tables are fine.

    Distinct (host, path) pairs are expanded, not pages, so that a host with a third of all rows is
    expanded once for each path. Spark broadcasts the rules only while they are below its own
    measured limit and joins by shuffle otherwise.
    """
    marks = anchors(rules)
    most = marks.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()
    host, path = url_parts(url)
    taken = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in taken]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    expressions = expand(split.select("host", "path").distinct(), most["labels"] or 1, most["slashes"] or 0)
    found = expressions.join(marks, "prefix").where(
        (F.col("digest") == F.col("rule_digest"))
        & ((F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host")))
        & F.startswith("path", F.col("rule_path"))
    )
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(name).alias("length"), (F.col("verdict") == "block").alias("blocks"), name.alias("rule"), "verdict")
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = split.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hit AS (
  SELECT p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(r.verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY 1, 2
)
SELECT page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hit h ON p.host = h.host AND p.path = h.path
"""
