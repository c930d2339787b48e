"""URL filters by hashed host-suffix and path-prefix expressions (operator 2) [DataFrame functions only].

Each distinct url is expanded into every (host suffix, path prefix) expression that a rule could
name; expressions and rules meet by an equi-join on a short prefix of their digests, full digests
and texts confirm, and the longest fitting rule (its host first where lengths are equal, then block
before allow) decides.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and takes
the default verdict; repeated urls and pages each keep their row; an empty table gives no rows; other
columns are ignored.  An empty rule table gives the default verdict everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import only, table

#: The contract's rules, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules up to this many are sent to every executor (about 100 bytes each); more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Salts for the shuffled join, so that expressions shared by many urls do not meet in one task.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _before(text: Column, marks: str) -> Column:
    return F.regexp_extract(text, f"^[^{marks}]*", 0)


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = _before(rest, "/?#")
    return df.withColumn("host", F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1), F.lit("")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, verdict for every row of ``pages``."""
    rules = (
        rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("rule_digest", 1, 8))
    )
    urls = with_host_and_path(pages.select("url").distinct())
    # The lengths that rule paths have: a set no larger than the longest rule.
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        urls.filter(F.col("host") != "")
        .crossJoin(F.broadcast(lengths))  # one row
        .withColumn("labels", labels)
        .select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    if rules.count() <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(rules), "short")
    else:
        salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    met = met.filter((F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), (F.col("verdict") == "block"), rule)
    best = met.groupBy("url").agg(F.max_by(F.struct(rule.alias("rule"), F.col("verdict").alias("by_rule")), rank).alias("best"))
    rows = with_host_and_path(pages)
    # Rows without a host fit no rule; they don't take part in the join.
    judged = rows.filter("host <> ''").join(best, "url", "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.by_rule", F.lit(default)).alias("verdict"))
    return judged.unionByName(rows.filter("host = ''").select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(table(spark, sf_dir, "pages"), {"page_id": "long", "url": "string"})
    return judge_urls(pages, rule_table(spark, RULES))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT p.*, r.verdict AS v, r.rh || r.rp AS rule_text, length(r.rh) AS hl
  FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
)
SELECT page_id, host, path, rule_text AS rule, coalesce(v, 'allow') AS verdict FROM fit
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_text) DESC NULLS LAST, hl DESC, v DESC) = 1
"""
