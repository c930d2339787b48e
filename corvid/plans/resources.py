"""Queries over declared infrastructure: folds, rules of three values, plans over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions.documents import at_path, text_of
from corvid.operators import resources as rs
from corvid.plans.registry import query
from corvid.sources import infrastructure as inf

_STORES = """
st AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS bal, 'repo' || (s_suppkey % 5) AS repo_id, 'bucket.s' || s_suppkey AS address,
  CASE s_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'k8s' END AS provider, CASE s_suppkey % 4 WHEN 2 THEN 'plan' WHEN 3 THEN 'state' ELSE 'hcl' END AS source,
  CASE WHEN s_nationkey % 6 = 0 THEN 'examples/n' ELSE 'infra/n' END || s_nationkey || '.tf' AS path, CAST(s_suppkey % 100 AS INTEGER) AS start_line FROM supplier),
ch AS (SELECT p_partkey AS p, p_size AS size, p_partkey % 10 AS k, p_size % 3 AS way, CASE WHEN p_size > 25 THEN 'public-read' ELSE 'private' END AS acl, p_partkey % 3 = 0 AS ingress FROM part)"""
#: Each store after its children are folded in: who gave its encryption, what came in, in order.
_FOLDED = """
lists AS (SELECT k, count(*) FILTER (ingress) AS n_in, count(*) FILTER (NOT ingress) AS n_out, string_agg('p' || p, ',' ORDER BY p) FILTER (ingress) AS ins, bool_or(size > 40) FILTER (ingress) AS open FROM ch WHERE way = 2 GROUP BY k),
enc AS (SELECT k, arg_min('a' || size, p) AS algo, arg_min('p' || p, p) AS tag FROM ch WHERE way = 0 GROUP BY k),
fo AS (SELECT st.*, CASE WHEN bal < 0 THEN 'public-read' ELSE 'private' END AS acl, algo, tag, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, ins, coalesce(open, false) AS open FROM st LEFT JOIN lists USING (k) LEFT JOIN enc USING (k))"""
#: Verdicts as SQL's three values: true, false, null.
_VERDICTS = """
v AS (
  SELECT k, 'not-encrypted' AS rule, CASE WHEN bal > 5000 OR n % 4 = 0 THEN true WHEN k % 7 = 0 THEN NULL ELSE false END AS ok FROM fo WHERE provider <> 'k8s'
  UNION ALL SELECT k, 'public', k % 13 = 0 OR acl <> 'public-read' FROM fo
  UNION ALL SELECT k, 'not-versioned', CASE WHEN k % 5 = 0 THEN true WHEN k % 11 = 0 THEN NULL ELSE false END FROM fo
  UNION ALL SELECT k, 'no-logging', EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey <> fo.k AND o.s_suppkey - o.s_suppkey % 3 = fo.k) FROM fo WHERE provider = 'aws'
  UNION ALL SELECT k, 'open-ingress', CASE WHEN open THEN false WHEN k % 10 = 3 THEN NULL ELSE true END FROM fo
  UNION ALL SELECT k, 'debug', k % 6 <> 0 AND k % 9 <> 0 FROM fo
  UNION ALL SELECT k, 'named-tag', k % 9 = 0 OR k % 6 > 1 FROM fo)"""


def _folded(spark, d):
    return rs.fold_children(inf.resources(spark, d), inf.CHILDREN)


@query("SELECT k * 2 AS seq, acl, algo, tag, CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, CASE WHEN n_in = 1 THEN NULL ELSE ins END AS ins, CASE WHEN n_in = 1 THEN ins END AS single FROM fo", _STORES, _FOLDED)
def resource_fold(spark, d):
    """[J15] What the stores have from their children."""
    p = F.col("properties")
    items = lambda way: F.try_variant_get(at_path(p, way, exact=True), "$", "array<variant>")
    one = lambda way: F.try_variant_get(at_path(p, way, exact=True), "$", "map<string,variant>").isNotNull()
    n = lambda way: F.coalesce(F.size(items(way)), F.when(one(way), 1), F.lit(0)).cast("long")
    nothing = lambda x: F.when(x != "None", x)
    tags = F.array_join(F.transform(items("ingress"), lambda e: text_of(at_path(e, "tag"))), ",")
    return _folded(spark, d).filter("native = 'bucket'").select("seq", text_of(at_path(p, "acl")).alias("acl"), nothing(text_of(at_path(p, "encryption.algo"))).alias("algo"), nothing(text_of(at_path(p, "encryption.tag"))).alias("tag"), n("ingress").alias("n_in"), n("egress").alias("n_out"), tags.alias("ins"), F.when(one("ingress"), text_of(at_path(p, "ingress.tag"))).alias("single"))


@query("SELECT p * 2 + 1 AS child, CAST(way AS INTEGER) AS place, k * 2 AS parent FROM ch WHERE k IN (SELECT k FROM st)", _STORES)
def resource_parents(spark, d):
    """[J15] Which child configures which store."""
    return rs.parents_of(inf.resources(spark, d), inf.CHILDREN)


@query("SELECT k * 2 AS seq, rule, CASE WHEN ok THEN 'satisfied' WHEN NOT ok THEN 'violated' ELSE 'unknown' END AS verdict FROM v", _STORES, _FOLDED, _VERDICTS)
def resource_verdicts(spark, d):
    """[R2] Every rule on every resource that it is about."""
    return rs.judge_resources(_folded(spark, d), inf.RULES)


@query(
    """SELECT 'resource.' || rule || CASE WHEN ok IS NULL THEN '.not-assessed' ELSE '' END AS rule_id, CASE WHEN ok IS NULL THEN 'Cannot evaluate: ' || title WHEN n % 6 = 0 THEN title || ' (example code)' ELSE title END AS title, dimension,
  CASE WHEN ok IS NULL THEN 'info' WHEN n % 6 = 0 THEN CASE sev WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE sev END ELSE sev END AS severity,
  CASE WHEN ok IS NULL THEN 'high' WHEN n % 6 = 0 THEN 'low' ELSE conf END AS confidence, repo_id, path, start_line, address AS logical, CASE WHEN ok IS NULL THEN 'unknown:' ELSE '' END || 'bucket ' || address AS evidence
FROM v JOIN st USING (k) JOIN ru USING (rule) WHERE ok IS DISTINCT FROM true AND (ok = false OR sev IN ('critical', 'high'))""",
    _STORES,
    _FOLDED,
    _VERDICTS,
    """
ru(rule, sev, conf, dimension, title) AS (VALUES ('not-encrypted', 'high', 'high', 'security', 'Store is not encrypted'), ('public', 'critical', 'high', 'security', 'Store is public'), ('not-versioned', 'medium', 'medium', 'compliance', 'Store keeps no versions'),
  ('no-logging', 'low', 'high', 'security', 'Store isn''t logged'), ('open-ingress', 'high', 'high', 'security', 'Ingress from anywhere'), ('debug', 'low', 'high', 'security', 'Debug settings'), ('named-tag', 'medium', 'high', 'quality', 'First tag isn''t prod'))""",
)
def resource_policy(spark, d):
    """[R2] Findings of the rules."""
    return rs.resource_findings(_folded(spark, d), inf.RULES)


@query(
    """SELECT 'resource.source-is-literal-hcl' AS rule_id, repo_id, arg_min(path, seq) FILTER (source = 'hcl') AS path, CAST(count(*) FILTER (source = 'hcl') AS BIGINT) AS n FROM r GROUP BY repo_id HAVING count(*) FILTER (source = 'hcl') > 0 AND count(*) FILTER (source <> 'hcl') = 0
UNION ALL SELECT 'resource.unknown-until-apply', repo_id, arg_min(path, seq) FILTER (source <> 'hcl'), CAST(any_value(w.n) AS BIGINT) FROM r JOIN (SELECT repo_id, count(*) AS n FROM v JOIN st USING (k) WHERE ok IS NULL GROUP BY 1) w USING (repo_id) GROUP BY repo_id HAVING count(*) FILTER (source <> 'hcl') > 0""",
    _STORES,
    _FOLDED,
    _VERDICTS,
    """
r AS (SELECT k * 2 AS seq, repo_id, source, path FROM st UNION ALL SELECT p * 2 + 1, 'repo' || (k % 5), CASE k % 4 WHEN 2 THEN 'plan' WHEN 3 THEN 'state' ELSE 'hcl' END, 'infra/parts.tf' FROM ch)""",
)
def resource_coverage(spark, d):
    """[R2] What the verdicts rest on."""
    return rs.resource_coverage(_folded(spark, d), inf.RULES)


@query(
    """SELECT CASE WHEN k % 2 = 0 THEN 'module.a.module.b.bucket.s' || k || '["x"]' ELSE address END AS address, CASE WHEN k % 2 = 0 THEN 'plan' ELSE 'hcl' END AS source, path, start_line FROM st
UNION ALL SELECT 'bucket.new' || k || '[0]', 'plan', 'plan.json', NULL FROM st WHERE k % 4 = 0""",
    _STORES,
)
def resource_plan_over_source(spark, d):
    """[J16] Every second store has a plan of its own, every fourth a planned one that no source declares."""
    stores = inf.resources(spark, d).filter("native = 'bucket'").withColumn("source", F.lit("hcl"))
    key, planned = F.col("seq") / 2, {"source": F.lit("plan"), "path": F.lit("plan.json"), "start_line": F.lit(None).cast("int")}
    plan = stores.filter(key % 2 == 0).withColumns(planned | {"address": F.concat(F.lit("module.a.module.b."), "address", F.lit('["x"]'))})
    new = stores.filter(key % 4 == 0).withColumns(planned | {"address": F.concat(F.lit("bucket.new"), key.cast("int").cast("string"), F.lit("[0]"))})
    return rs.plan_over_source(stores.unionByName(plan).unionByName(new)).select("address", "source", "path", "start_line")
