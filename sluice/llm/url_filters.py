"""URL rules: allow and block lists over host suffixes and path prefixes.

Every distinct (host, path) is expanded into the host suffixes and path prefixes that
the rules could name, each expression is joined to the rules on a 32-bit prefix of its
SHA-256, and a hit counts only if the full digests agree. Of the rules that fit, the
longest decides; of rules equally long, the longer host, then block.

Copies of an URL are judged once, so a host or URL that a third of all pages share
costs what one page costs; the verdicts return by a plain equi-join, which adaptive
execution splits where a key is hot. Only label counts and path lengths that occur
among the rules are expanded, so odd URLs with thousands of dots or slashes stay small.

Defined results: a null URL or one without "://" has an empty host and path, fits no
rule and gets the default verdict. Repeated rows are judged alike and all kept. Null
page ids stay null. An empty table or an empty rule list gives no hits. Extra columns
are kept by `judge`, under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_at_most, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are sent to all tasks; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict (allow or block). One row for each host and path; block wins over allow."""
    path = F.when(F.coalesce("path", F.lit("")).startswith("/") | (F.coalesce("path", F.lit("")) == ""), F.coalesce("path", F.lit(""))).otherwise(F.concat(F.lit("/"), "path"))
    rows = rules.where(F.length("host") > 0).select(F.translate("host", UPPER, LOWER).alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
    rows = rows.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return rows.withColumns({"r_digest": digest, "r_short": _short(digest)})


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each distinct host and path that a rule fits."""
    spark = urls.sparkSession
    rules = rule_table(rules)
    n_labels = F.size(F.split("r_host", "\\."))
    # Distinct small integers, bounded by the longest host and path that a rule may have.
    kinds = rules.agg(F.collect_set(n_labels).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    if not kinds["labels"]:
        return spark.createDataFrame([], "host string, path string, rule string, verdict string")
    labels = F.array(*[F.lit(x) for x in sorted(kinds["labels"])])
    lengths = F.array(*[F.lit(x) for x in sorted(kinds["lengths"])])
    distinct = urls.where(F.length("host") > 0).select("host", "path").distinct()
    suffixes = let(
        F.split("host", "\\."),
        lambda parts: F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")),
    )
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", _short(F.col("digest")))
    )
    side = F.broadcast(rules) if counted_at_most(rules, BROADCAST_RULES) else rules
    hits = expressions.join(side, F.col("short") == F.col("r_short")).where(F.col("digest") == F.col("r_digest"))
    size = F.length("r_host") + F.length("r_path")
    order = F.struct(size.alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (pages' own columns of these names are dropped)."""
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    best = best_rules(pages, rules).withColumnsRenamed({"host": "b_host", "path": "b_path", "verdict": "b_verdict"})
    out = pages.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return out.withColumn("verdict", F.coalesce("b_verdict", F.lit(default))).drop("b_host", "b_path", "b_verdict")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM u),
     p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
     r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     k AS (SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
           FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, k.rule, coalesce(k.verdict, 'allow') AS verdict FROM p LEFT JOIN k ON p.host = k.host AND p.path = k.path
"""
