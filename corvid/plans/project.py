"""Queries over the project graph: resolution, neighbourhoods, why, impact and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.catalogue import _FINDINGS
from corvid.operators import answers as an
from corvid.operators import graphs as g
from corvid.plans.registry import query
from corvid.sources import project as pr

_PNODES = """
n AS (
  SELECT 'req:' || c_custkey AS id, 'requirement' AS kind, c_name AS name, '' AS file, CAST(NULL AS VARCHAR) AS date, false AS directory, false AS test FROM customer
  UNION ALL SELECT 'commit:' || o_orderkey, 'commit', 'Order#:' || o_orderkey, '', strftime(o_orderdate, '%Y-%m-%d'), false, false FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'module', p_name, p_brand || '/' || p_partkey || '.py', NULL, false, p_size >= 45 FROM part
  UNION ALL SELECT DISTINCT 'file:' || p_brand, 'file', p_brand, p_brand, NULL, true, false FROM part
  UNION ALL SELECT 'suite:' || s_suppkey, 'suite', s_name, '', NULL, false, false FROM supplier
  UNION ALL SELECT 'failure:' || n_nationkey, 'failure', n_name, '', NULL, false, false FROM nation
  UNION ALL SELECT 'rule:' || r_regionkey, 'rule', r_name, '', NULL, false, false FROM region
  UNION ALL SELECT 'finding:' || seq, 'finding', title, '', NULL, false, false FROM f
  UNION ALL SELECT DISTINCT 'finding_rule:' || rule_id, 'finding_rule', rule_id, '', NULL, false, false FROM f
  UNION ALL SELECT DISTINCT 'cwe:' || probe, 'cwe', probe, '', NULL, false, false FROM f)"""
_PEDGES = """
i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
big AS (SELECT p_partkey AS p FROM part WHERE p_size >= 45),
e AS MATERIALIZED (
  SELECT 'commit:' || o_orderkey AS source, 'req:' || o_custkey AS target, 'delivers' AS type, 'EXTRACTED' AS provenance FROM orders
  UNION ALL SELECT DISTINCT 'commit:' || o, 'part:' || p, 'modifies', 'EXTRACTED' FROM i
  UNION ALL SELECT 'commit:' || o_orderkey, 'commit:' || before, 'follows', 'EXTRACTED' FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL
  UNION ALL SELECT DISTINCT 'req:' || o_custkey, 'part:' || p, 'touches', 'INFERRED' FROM i JOIN orders ON o = o_orderkey
  UNION ALL SELECT 'req:' || c_custkey, 'file:Brand#' || (c_nationkey + 1), 'touches', 'EXTRACTED' FROM customer
  UNION ALL SELECT DISTINCT 'suite:' || s, 'part:' || p, 'covers', 'EXTRACTED' FROM i
  UNION ALL SELECT DISTINCT 'suite:' || s, 'part:' || p, 'contains', 'EXTRACTED' FROM i WHERE p IN (SELECT p FROM big)
  UNION ALL SELECT 'file:' || p_brand, 'part:' || p_partkey, 'contains', 'EXTRACTED' FROM part
  UNION ALL SELECT DISTINCT 'part:' || a.p, 'part:' || b.p, 'verifies', 'INFERRED' FROM i a JOIN i b ON a.o = b.o WHERE a.p IN (SELECT p FROM big) AND b.p NOT IN (SELECT p FROM big)
  UNION ALL SELECT 'failure:' || c_nationkey, 'req:' || c_custkey, 'arose_in', 'EXTRACTED' FROM customer
  UNION ALL SELECT 'failure:' || n_nationkey, 'file:Brand#' || (n_nationkey + 1), 'affects', 'EXTRACTED' FROM nation
  UNION ALL SELECT 'failure:' || n_nationkey, 'rule:' || n_regionkey, 'prevented_by', 'EXTRACTED' FROM nation
  UNION ALL SELECT 'finding:' || event_id, 'req:' || user_id, 'cites', 'EXTRACTED' FROM events
  UNION ALL SELECT 'finding:' || seq, 'part:' || start_line, 'flags', 'EXTRACTED' FROM f JOIN part ON p_partkey = start_line
  UNION ALL SELECT 'finding:' || seq, 'finding_rule:' || rule_id, 'violates', 'EXTRACTED' FROM f
  UNION ALL SELECT 'finding:' || seq, 'cwe:' || probe, 'classified_as', 'EXTRACTED' FROM f
  UNION ALL SELECT DISTINCT 'finding_rule:' || rule_id, 'cwe:' || probe, 'classified_as', 'EXTRACTED' FROM f
  UNION ALL SELECT DISTINCT 'finding_rule:' || rule_id, 'req:' || split_part(rule_id, '.', 2), 'specified_by', 'EXTRACTED' FROM f)"""
_GRAPH = (_FINDINGS, _PNODES, _PEDGES)


def _graph(spark, d):
    return pr.nodes(spark, d), pr.edges(spark, d)


@query("SELECT type, provenance, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e GROUP BY ALL", *_GRAPH)
def project_edges(spark, d):
    return pr.edges(spark, d).groupBy("type", "provenance").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


@query("SELECT kind, count(*) AS n, count_if(test) AS tests, count_if(directory) AS directories FROM n GROUP BY 1", _FINDINGS, _PNODES)
def project_nodes(spark, d):
    return pr.nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("test").alias("tests"), F.count_if("directory").alias("directories"))


RESOLVED = ["Brand#3", "click", "small ring", "part:17", "Nation_4", "brand#2", "no such thing", "view.3"]


@query(
    "SELECT text, id FROM c WHERE m = 1 UNION ALL SELECT text, id FROM k WHERE m = 1",
    _FINDINGS,
    _PNODES,
    f" t(text) AS (VALUES {', '.join(f'({x!r})' for x in RESOLVED)}), h AS (SELECT t.text, n.*, CASE WHEN n.id = t.text THEN 0 WHEN n.name = t.text THEN 1 WHEN contains(lower(n.name), lower(t.text)) THEN 2 END AS tier FROM n, t), b AS (SELECT * FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY text)), c AS (SELECT *, count(*) OVER (PARTITION BY text) AS m FROM b),"
    f" k AS (SELECT text, kind, count(*) AS m, min(id) AS id FROM c WHERE m > 1 AND name = text AND list_position({g.KIND_RANK!r}, kind) > 0 GROUP BY text, kind QUALIFY row_number() OVER (PARTITION BY text ORDER BY list_position({g.KIND_RANK!r}, kind)) = 1)",
)
def graph_resolve_one(spark, d):
    nodes = pr.nodes(spark, d)
    out = None
    for text in RESOLVED:
        one = g.resolve_one(nodes, text).select(F.lit(text).alias("text"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'out' AS way, type, target AS id, n.kind, n.name FROM e LEFT JOIN n ON n.id = target WHERE source = 'commit:12' UNION ALL SELECT 'in', type, source, n.kind, n.name FROM e LEFT JOIN n ON n.id = source WHERE target = 'commit:12'", *_GRAPH)
def graph_show(spark, d):
    return an.neighbourhood(*_graph(spark, d), "commit:12")


@query("SELECT id, kind, name, nullif(file, '') AS file, date FROM n", _FINDINGS, _PNODES)
def graph_describe(spark, d):
    return an.describe(pr.nodes(spark, d)).select("id", "kind", "name", "file", F.try_element_at("fields", F.lit("date")).alias("date"))


_LISTED = "SELECT section, x.id, n.kind, n.name, arg_min(via, rank) AS via FROM x JOIN n USING (id) WHERE x.id <> {me} GROUP BY section, x.id, n.kind, n.name"


@query(
    _LISTED.format(me="'req:7'"),
    *_GRAPH,
    """
x AS (
  SELECT 'files touched' AS section, target AS id, CASE provenance WHEN 'EXTRACTED' THEN 'declared scope' ELSE 'git history' END AS via, 0 AS rank FROM e WHERE source = 'req:7' AND type = 'touches'
  UNION ALL SELECT CASE type WHEN 'delivers' THEN 'commits' WHEN 'arose_in' THEN 'failures' ELSE 'finding rules' END, source, '', 0 FROM e WHERE target = 'req:7' AND type IN ('delivers', 'arose_in', 'specified_by')
  UNION ALL SELECT 'findings', a.source, '', 0 FROM e a JOIN e b ON a.target = b.source WHERE b.target = 'req:7' AND b.type = 'specified_by' AND a.type = 'violates')""",
)
def graph_why_requirement(spark, d):
    return an.why(*_graph(spark, d), "req:7")


@query(
    _LISTED.format(me="'commit:12'"),
    *_GRAPH,
    """
x AS (
  SELECT CASE type WHEN 'delivers' THEN 'requirements' WHEN 'modifies' THEN 'files modified' ELSE 'previous commit' END AS section, target AS id, '' AS via, 0 AS rank FROM e WHERE source = 'commit:12'
  UNION ALL SELECT 'next commit', source, '', 0 FROM e WHERE target = 'commit:12' AND type = 'follows')""",
)
def graph_why_commit(spark, d):
    return an.why(*_graph(spark, d), "commit:12")


@query(
    _LISTED.format(me="'cwe:click'"),
    *_GRAPH,
    """
r AS (SELECT source FROM e WHERE target = 'cwe:click'),
x AS (
  SELECT 'findings' AS section, source AS id, '' AS via, 0 AS rank FROM r WHERE source LIKE 'finding:%'
  UNION ALL SELECT 'rules', source, '', 0 FROM r WHERE source LIKE 'finding_rule:%'
  UNION ALL SELECT 'files', target, '', 0 FROM e JOIN r USING (source) WHERE type = 'flags')""",
)
def graph_why_weakness(spark, d):
    return an.why(*_graph(spark, d), "cwe:click")


@query(
    _LISTED.format(me="'part:17'") + " UNION ALL SELECT 'gaps', '-', 'gap', 'no test references this', '' FROM n WHERE id = 'part:17' AND NOT test AND NOT EXISTS (SELECT 1 FROM x WHERE section = 'tests' AND id <> 'part:17')",
    *_GRAPH,
    """
me AS (SELECT 'part:17' AS id, 'file:' || p_brand AS folder, p_brand AS name FROM part WHERE p_partkey = 17),
around AS (SELECT e.*, target = folder AS above, name AS folder_name FROM e, me WHERE target IN (id, folder)),
tests AS (SELECT source FROM around WHERE type = 'verifies'), failed AS (SELECT source FROM around WHERE type = 'affects'),
x AS (
  SELECT 'requirements' AS section, source AS id, CASE WHEN provenance = 'INFERRED' THEN 'changed in git history' WHEN above THEN 'directory scope ' || folder_name ELSE 'declared scope' END AS via, CASE WHEN provenance = 'INFERRED' THEN 0 WHEN above THEN 3 ELSE 1 END AS rank FROM around WHERE type = 'touches'
  UNION ALL SELECT CASE type WHEN 'modifies' THEN 'commits' WHEN 'flags' THEN 'findings' ELSE 'test suites' END, source, '', 0 FROM around WHERE type IN ('modifies', 'flags', 'covers')
  UNION ALL SELECT 'tests', source, '', 0 FROM tests UNION ALL SELECT 'failures', source, '', 0 FROM failed
  UNION ALL SELECT 'test suites', source, '', 0 FROM e WHERE type = 'contains' AND target IN (SELECT source FROM tests)
  UNION ALL SELECT 'rules and playbooks from those failures', target, '', 0 FROM e WHERE type = 'prevented_by' AND source IN (SELECT source FROM failed))""",
)
def graph_why_code(spark, d):
    return an.why(*_graph(spark, d), "part:17")


_WALK = """
bw AS (SELECT source AS parent, target AS id, type FROM e WHERE type <> 'follows' UNION SELECT target, source, type FROM e WHERE type <> 'follows'),
l0 AS ({seeds}),
l1 AS (SELECT b.id, n.kind, n.name, b.type AS via, s.id AS parent, list_concat(s.key, [n.name, b.type, b.id]) AS key, 1 AS hops FROM l0 s JOIN bw b ON b.parent = s.id JOIN n ON n.id = b.id
  WHERE (b.type NOT IN ('violates', 'classified_as') OR s.kind IN ('cwe', 'finding_rule')) AND b.id NOT IN (SELECT id FROM l0) QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY s.key, b.type) = 1),
l2 AS (SELECT b.id, n.kind, n.name, b.type AS via, s.id AS parent, list_concat(s.key, [n.name, b.type, b.id]) AS key, 2 AS hops FROM l1 s JOIN bw b ON b.parent = s.id JOIN n ON n.id = b.id
  WHERE (b.type NOT IN ('violates', 'classified_as') OR s.kind IN ('cwe', 'finding_rule')) AND b.id NOT IN (SELECT id FROM l0) AND b.id NOT IN (SELECT id FROM l1) QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY s.key, b.type) = 1),
x AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
y AS (SELECT CASE x.kind WHEN 'requirement' THEN 'requirements' WHEN 'commit' THEN 'commits' WHEN 'suite' THEN 'suites' WHEN 'failure' THEN 'failures' WHEN 'rule' THEN 'rules' WHEN 'finding' THEN 'findings'
  ELSE CASE WHEN n.test THEN 'tests' WHEN via = 'flags' AND x.kind IN ('module', 'file') AND NOT n.directory THEN 'files' END END AS bucket, x.id, x.kind, x.name, via, hops, parent FROM x JOIN n USING (id))"""
_SEEDED = "SELECT id, kind, name, [id] AS key FROM n WHERE "


@query("SELECT * FROM y WHERE bucket IS NOT NULL", *_GRAPH, _WALK.format(seeds=_SEEDED + "id IN ('part:3', 'part:17') OR id IN (SELECT 'file:' || p_brand FROM part WHERE p_partkey IN (3, 17))"))
def graph_impact(spark, d):
    nodes, edges = _graph(spark, d)
    changed = nodes.filter("id IN ('part:3', 'part:17')").select(F.concat(F.lit("./"), "file").alias("path"))
    return g.impact(nodes, edges, changed)


@query("SELECT * FROM y WHERE bucket IS NOT NULL", *_GRAPH, _WALK.format(seeds=_SEEDED + "id = 'finding_rule:view.3'"))
def graph_impact_of_rule(spark, d):
    return g.impact(*_graph(spark, d), spark.createDataFrame([("view.3",)], "path string"))


_FLOW = f"""
flow AS (SELECT source AS up, target AS down, type, false AS once FROM e WHERE type IN ({', '.join(map(repr, g.DOWN))}) UNION SELECT target, source, type, false FROM e WHERE type IN ({', '.join(map(repr, g.UP))}) UNION SELECT target, source, type, true FROM e WHERE type = 'follows'),
l0 AS (SELECT id, [id] AS key FROM n WHERE id = '{{origin}}'),
l1 AS (SELECT t.{{b}} AS id, n.name, n.kind, t.type AS via, s.id AS parent, list_concat(s.key, [n.name, t.type, t.{{b}}]) AS key, t.type IN ('defines', 'contains') AS inside, NOT once AS walked, 1 AS hops FROM l0 s JOIN flow t ON t.{{a}} = s.id JOIN n ON n.id = t.{{b}}
  WHERE t.{{b}} <> s.id QUALIFY row_number() OVER (PARTITION BY t.{{b}} ORDER BY s.key, t.type) = 1),
l2 AS (SELECT t.{{b}} AS id, n.name, n.kind, t.type AS via, s.id AS parent, 2 AS hops FROM l1 s JOIN flow t ON t.{{a}} = s.id JOIN n ON n.id = t.{{b}}
  WHERE walked AND NOT once AND ({{loose}} OR t.type NOT IN ('defines', 'contains') OR inside) AND t.{{b}} NOT IN (SELECT id FROM l0) AND t.{{b}} NOT IN (SELECT id FROM l1) QUALIFY row_number() OVER (PARTITION BY t.{{b}} ORDER BY s.key, t.type) = 1)"""
_LINEAGE = "SELECT id, name, kind, via, parent, hops FROM l1 UNION ALL SELECT id, name, kind, via, parent, hops FROM l2"


def _lineage(spark, d, origin, direction):
    return g.lineage(*_graph(spark, d), origin, direction, depth=2, limit=None).select("id", "name", "kind", "via", "parent", "hops")


@query(_LINEAGE, *_GRAPH, _FLOW.format(origin="req:7", a="up", b="down", loose="false"))
def graph_lineage_down(spark, d):
    return _lineage(spark, d, "req:7", "down")


@query(_LINEAGE, *_GRAPH, _FLOW.format(origin="commit:12", a="down", b="up", loose="true"))
def graph_lineage_up(spark, d):
    return _lineage(spark, d, "commit:12", "up")


@query("SELECT id, kind, out_degree, in_degree FROM (SELECT n.id, kind, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM n LEFT JOIN (SELECT source AS id, count(*) AS c FROM e GROUP BY 1) o USING (id) LEFT JOIN (SELECT target AS id, count(*) AS c FROM e GROUP BY 1) i USING (id)) QUALIFY row_number() OVER (ORDER BY out_degree + in_degree DESC, id) <= 25 OR kind = 'rule'", *_GRAPH)
def graph_top_degree(spark, d):
    return g.top_degree(*_graph(spark, d), 25, ["rule"]).select("id", "kind", "out_degree", "in_degree")


@query("SELECT 'file:' || p_brand AS source, 'part:' || p_partkey AS target FROM part")
def graph_directories(spark, d):
    return g.directory_edges(pr.nodes(spark, d))
