"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every url becomes the expressions (suffix of its host by labels, prefix of its
path) that could equal a rule. They are equi-joined with the rules on the first
eight hex digits of a SHA-256, the full digest confirms a match, and the longest
rule gives the verdict. Distinct (host, judged part of the path) are judged once,
so one popular host costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, UPPER, broadcast_if_small, carried, materialize, table

#: (action, host, path), as the contract states them.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Up to so many different pairs of label count and path length in the rules, a url expands to those only.
MOST_SHAPES = 4096


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' without '://' or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(action, host, path) from a list, as literals."""
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("action", "host", "path"), rule)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages (url, ...).

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins
    (characters of host and path; then the longer host; then block before allow). Without one, rule is
    null and the verdict is `default`. A null url, or one without '://', has empty host and path.
    Repeated rows are judged alike and all kept. Other columns stay, whatever their names; those named
    like an added one are replaced. Empty pages or rules are no special case.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    ruled = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        "action", F.col("host").alias("suffix"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), F.size(F.split("host", "\\.")).alias("labels")
    )
    shapes = ruled.select("labels", "path_len").distinct().limit(MOST_SHAPES + 1).collect()
    known = len(shapes) <= MOST_SHAPES  # else a url's suffixes are looked up first, and expand to the path lengths of their own rules
    labels, lengths = sorted({r[0] for r in shapes}), sorted({r[1] for r in shapes})
    away, _, back = carried(own)
    split = pages.select(*away, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    head = F.substring("path", 1, max(lengths, default=0)) if known else F.col("path")
    judged = split.select("host", head.alias("head")).distinct()

    literal = lambda numbers: F.array(*[F.lit(n) for n in numbers]).cast("array<int>")
    parts = F.split("host", "\\.")
    at_labels = F.filter(literal(labels), lambda k: k <= F.size(parts)) if known else F.sequence(F.lit(1), F.size(parts))
    hosts = judged.select("host", "head", F.explode(F.transform(at_labels, lambda k: F.concat_ws(".", F.slice(parts, -k, k)))).alias("suffix"))
    of_host = ruled.groupBy("suffix").agg(F.collect_set("path_len").alias("lengths"))
    hosts = hosts.withColumn("lengths", literal(lengths)) if known else hosts.join(of_host, "suffix")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n))
    expanded = hosts.select("host", "head", "suffix", F.explode(prefixes).alias("prefix"))
    keyed_urls = expanded.select("host", "head", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    keyed_rules = ruled.select("action", "rule", "host_len", F.sha2("rule", 256).alias("full")).withColumn("short", F.substring("full", 1, 8))
    hits = keyed_urls.join(keyed_rules, "short").filter("digest = full")
    rank = F.struct(F.length("rule"), "host_len", (F.col("action") == "block").cast("int"))
    best = materialize(hits.groupBy("host", "head").agg(F.max_by(F.struct("rule", "action"), rank).alias("best")), "judged")
    # a row for each host and path that a rule fits; small, it goes to the urls, so that a popular host stays spread
    found = broadcast_if_small(best, 128 + F.octet_length("host") + F.octet_length("head") + F.octet_length("best.rule"))
    named = split.withColumn("head", head).join(found, ["host", "head"], "left")
    return named.select(*back, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by RULES; allow where none fits."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH r(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, coalesce(r.action, 'allow') AS verdict
FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
QUALIFY row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
"""
