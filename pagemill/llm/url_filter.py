"""URL filtering by host and path rules: expressions, short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import join_by_key, materialise, nested, read_table, unnested

#: Rule lists up to this many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the digest that the join uses (32 bits).
PREFIX_DIGITS = 8
#: The rules of the query: host, path, action.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; other letters are left as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, ASCII lower case) and path (up to ``?`` or ``#``); both empty without ``://`` or for null."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(known, shape, 1)), F.regexp_extract(known, shape, 2)


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host and its parents, of most_labels labels at most."""
    labels = F.split(host, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )


def path_prefixes(path: Column, most_parts: int) -> Column:
    """The prefixes of the path that end at a slash (and the empty one), of most_parts slashes at most."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most_parts))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))),
    )


def digest(host: Column, prefix: Column) -> Column:
    """The full digest of an expression. A NUL separates host and path, so that no two expressions read alike."""
    return F.sha2(F.concat(host, F.lit("\u0000"), prefix), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls (host, path and other columns) with ``rule`` and ``verdict``.

    rules: host, path, action. A rule fits its host and all subdomains of it if the path starts with the rule's
    path; of several, the one with the longest host and path together wins, then the longer host, then the
    greater text. Where no rule fits, rule is null and the verdict is default.

    A rule is looked up by the digest of its host and its path up to the last slash. Each URL is expanded into the
    digests of its host suffixes and path prefixes, no deeper than the deepest rule, joined by the digests' first
    32 bits, then confirmed by full digest and full path. Each pair of host and path is judged once and brought back to
    its rows by join_by_key, so a URL that fills a third of the table costs no more than any other. A long list
    of rules is joined with the distinct expressions; those found go back to their URLs in the same way, as an expression
    such as a top-level domain may belong to half of them.
    Null host or path count as empty. Columns named rule or verdict are replaced; others stay. Rules with null host, path or action are ignored.
    """
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    keyed = known.select(
        ascii_lower(F.col("host")).alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("action").alias("rule_action"),
        F.regexp_extract("path", r"(?s)^(.*/)", 1).alias("key_path"),
    ).distinct()
    n_rules, labels, parts = keyed.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("rule_host", "\\."))), F.max(F.size(F.split("key_path", "/")) - 1)
    ).first()
    keyed = keyed.select("*", digest(F.col("rule_host"), F.col("key_path")).alias("rule_digest")).withColumn(
        "short", F.substring("rule_digest", 1, PREFIX_DIGITS)
    )

    known_url = urls.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    packed = nested(known_url).withColumn("url_", F.struct("row_.host", "row_.path"))
    once = materialise(packed.groupBy("url_").agg(F.count(F.lit(1)).alias("copies_")), "urls")
    expanded = once.withColumn("suffix_", F.explode(host_suffixes(F.col("url_.host"), labels or 1))).withColumn("prefix_", F.explode(path_prefixes(F.col("url_.path"), parts or 0)))
    hashed = expanded.select("url_", digest(F.col("suffix_"), F.col("prefix_")).alias("digest_")).withColumn("short", F.substring("digest_", 1, PREFIX_DIGITS))
    if n_rules <= BROADCAST_RULES:
        met = hashed.join(F.broadcast(keyed), "short").where(F.col("digest_") == F.col("rule_digest"))
    else:
        distinct = hashed.groupBy("short", "digest_").agg(F.count(F.lit(1)).alias("n_"))
        found = materialise(distinct.join(keyed, "short").where(F.col("digest_") == F.col("rule_digest")).groupBy("digest_", "n_").agg(
            F.collect_list(F.struct("rule_host", "rule_path", "rule_action")).alias("rules_")), "matches")
        total = distinct.agg(F.sum("n_")).first()[0] or 0
        met = join_by_key(hashed.select("url_", "digest_"), found, "digest_", "n_", total).select("url_", F.inline("rules_"))
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(text).alias("n"), F.length("rule_host").alias("h"), text.alias("rule"), F.col("rule_action").alias("action")))
    judged = met.where(F.startswith(F.col("url_.path"), F.col("rule_path"))).groupBy("url_").agg(best.alias("best_"))
    verdicts = materialise(once.join(judged, "url_", "left"), "verdicts")
    again = join_by_key(packed, verdicts, "url_", "copies_", verdicts.agg(F.sum("copies_")).first()[0] or 0)
    return unnested(again, known_url, {"rule": F.col("best_.rule"), "verdict": F.coalesce("best_.action", F.lit(default))})


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under RULES; what no rule fits is allowed."""
    host, path = url_parts(F.col("url"))
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(pages.select("page_id", host.alias("host"), path.alias("path")), rules)


SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules r
    ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
