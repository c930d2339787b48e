"""Queries over change sets: gates, attribution, merged reports, matching, and statistics of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.catalogue import _BEFORE, _CARD, _FINDINGS, _PROBES, _card, _halves, _probes
from corvid.functions import scalars as sc
from corvid.operators import changes as ch
from corvid.operators import findings as fi
from corvid.operators import matching as mt
from corvid.operators import sets as se
from corvid.operators import stats as st
from corvid.plans.registry import query
from corvid.sources import records as rc
from corvid.sources import tables as src

_PATH = "'d' || (o_custkey % 7) || '/f' || o_custkey || '.py'"
_COMMITS = f"""
commits AS (SELECT o_orderkey AS hash, {_PATH} AS path, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Fix REQ-' || (o_orderkey % 40) || ' and OLD-' || (o_orderkey % 5) || CASE WHEN o_orderkey % 3 = 0 THEN ' see ABC-1' ELSE '' END AS message FROM orders),
recent AS (SELECT * FROM commits WHERE date >= '2000-09-01'),
cites AS (SELECT DISTINCT hash, CASE WHEN old LIKE 'OLD-%' THEN 'REQ-' || (50 + CAST(substr(old, 5) AS INTEGER)) ELSE old END AS id FROM (SELECT hash, unnest(regexp_extract_all(message, '\\b([A-Z][A-Z0-9]*-[0-9]+)\\b', 1)) AS old FROM recent) WHERE old NOT LIKE 'ABC-%'),
changed AS (SELECT DISTINCT path FROM commits WHERE date >= '2000-06-01'),
own AS (SELECT path, list_sort(list_distinct(list(id))) AS ids FROM recent JOIN cites USING (hash) GROUP BY 1),
every AS (SELECT list_sort(list_distinct(list(id))) AS ids FROM cites),
tagged AS (SELECT f.*, CASE WHEN c.path IS NULL THEN CAST([] AS VARCHAR[]) WHEN own.ids IS NOT NULL THEN list_concat(list_transform(own.ids, lambda x: 'req:' || x), ['req-scope:commits']) ELSE list_concat(list_transform(every.ids, lambda x: 'req:' || x), ['req-scope:open']) END AS tags
  FROM f LEFT JOIN changed c USING (path) LEFT JOIN own USING (path), every)"""


def _commits(spark, d):
    key = F.col("o_custkey")
    path = F.concat(F.lit("d"), (key % 7).cast("string"), F.lit("/f"), key.cast("string"), F.lit(".py"))
    k = F.col("o_orderkey")
    message = F.concat(F.lit("Fix REQ-"), (k % 40).cast("string"), F.lit(" and OLD-"), (k % 5).cast("string"), F.when(k % 3 == 0, " see ABC-1").otherwise(""))
    return src.table(spark, d, "orders").select(k.alias("hash"), path.alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), message.alias("message"))


def _aliases(spark):
    return spark.createDataFrame([(f"OLD-{k}", f"REQ-{50 + k}") for k in range(5)], "old string, new string")


def _recent(spark, d):
    commits = _commits(spark, d).filter("date >= '2000-06-01'")
    return commits, commits.filter("date >= '2000-09-01'")  # the range of commits; what changed before them is open work


def _tagged(spark, d):
    changed, recent = _recent(spark, d)
    return ch.attribute_requirements(src.findings(spark, d), recent, recent.select("hash", "path"), changed.select("path"), _aliases(spark))


@query("SELECT seq, array_to_string(tags, ',') AS tags FROM tagged", _FINDINGS, _COMMITS)
def requirement_tags(spark, d):
    return _tagged(spark, d).select("seq", F.array_join("tags", ",").alias("tags"))


@query(
    "SELECT requirement, critical, high, medium, low, info, titles FROM counts JOIN (SELECT requirement, string_agg(title, ';' ORDER BY seq) AS titles FROM (SELECT * FROM (SELECT requirement, title, min(seq) AS seq FROM parts GROUP BY requirement, title) QUALIFY row_number() OVER (PARTITION BY requirement ORDER BY seq) <= 3) GROUP BY 1) USING (requirement)",
    _FINDINGS,
    _COMMITS,
    " parts AS (SELECT seq, severity, title, unnest(list_transform(list_filter(tags, lambda x: starts_with(x, 'req:')), lambda x: substr(x, 5))) AS requirement FROM tagged UNION ALL SELECT seq, severity, title, 'unattributed' FROM tagged WHERE len(list_filter(tags, lambda x: starts_with(x, 'req:'))) = 0),"
    " counts AS (SELECT requirement, " + ", ".join(f"count_if(severity = '{s}') AS {s}" for s in sc.SEVERITIES) + " FROM parts GROUP BY 1)",
)
def requirement_rows(spark, d):
    return ch.by_requirement(_tagged(spark, d)).withColumn("titles", F.array_join("titles", ";"))


@query("SELECT id, min(date) AS first, max(date) AS last, count(*) AS commits FROM cites JOIN recent USING (hash) GROUP BY 1", _FINDINGS, _COMMITS)
def requirement_activity(spark, d):
    _, recent = _recent(spark, d)
    return ch.requirement_activity(recent, ch.cited_ids(recent, "hash", _aliases(spark)))


@query("SELECT DISTINCT id FROM cites WHERE id NOT IN (SELECT 'REQ-' || n_nationkey FROM nation)", _FINDINGS, _COMMITS)
def unknown_requirements(spark, d):
    _, recent = _recent(spark, d)
    known = src.table(spark, d, "nation").select(F.concat(F.lit("REQ-"), F.col("n_nationkey").cast("string")).alias("id"))
    return ch.unknown_ids(ch.cited_ids(recent, "hash", _aliases(spark)), known)


@query(
    "SELECT 'code' AS gate, count_if(path LIKE 'd1/%') AS triggers, bool_or(path LIKE 'd9/%') AS met, count_if(path LIKE 'd1/%') > 0 AND NOT bool_or(path LIKE 'd9/%') AS violated FROM changed UNION ALL SELECT 'docs', count_if(path LIKE 'd2/%' AND path NOT LIKE 'd2/f1%'), bool_or(path LIKE 'd3/%'), count_if(path LIKE 'd2/%' AND path NOT LIKE 'd2/f1%') > 0 AND NOT bool_or(path LIKE 'd3/%') FROM changed",
    _FINDINGS,
    _COMMITS,
)
def co_change_gate(spark, d):
    changed = _recent(spark, d)[0].select("path")
    code = ch.co_changed(changed, ["d1/**"], ["d9/**", "docs/*.md"]).withColumn("gate", F.lit("code"))
    return code.unionByName(ch.co_changed(changed, ["**/d2/*.py"], ["d3/*"], ["d2/f1*"]).withColumn("gate", F.lit("docs"))).select("gate", "triggers", "met", "violated")


@query(
    "SELECT path, 1 + length(before) - length(replace(before, chr(10), '')) AS line, message FROM (SELECT 'doc/' || lang || '/' || doc_id AS path, message, substr(text, 1, strpos(text, hit) - 1) AS before FROM (SELECT *, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'markers' WHEN contains(text, '!!') THEN 'shouting' END AS message, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN regexp_extract(text, '[#$%&*]{3}') ELSE '!!' END AS hit FROM documents WHERE lang <> 'es') WHERE message IS NOT NULL)"
)
def forbidden_content(spark, d):
    files = src.table(spark, d, "documents").select(F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return ch.forbidden_content(files, [("[#$%&*]{3}", "markers"), ("!!", "shouting")], ["doc/**"], ["**/es/*"])


@query(
    "SELECT DISTINCT suite FROM suites, changed WHERE CASE WHEN contains(entry, '*') THEN regexp_matches(path, '^' || replace(replace(entry, '.', '\\.'), '*', '.*') || '$') ELSE path = entry OR starts_with(path, entry || '/') OR starts_with(entry, path || '/') END",
    _FINDINGS,
    _COMMITS,
    " suites AS (SELECT s_suppkey AS suite, CASE s_suppkey % 4 WHEN 0 THEN 'd' || (s_suppkey % 9) WHEN 1 THEN 'd' || (s_suppkey % 7) || '/f' || s_suppkey || '.py' WHEN 2 THEN 'd' || (s_suppkey % 7) || '/f' || s_suppkey || '.py/inner' ELSE 'd' || (s_suppkey % 9) || '/f' || (s_suppkey % 10) || '*.py' END AS entry FROM supplier)",
)
def impacted_suites(spark, d):
    k = F.col("s_suppkey")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    entry = F.when(k % 4 == 0, text("./d", k % 9, "/")).when(k % 4 == 1, text("d", k % 7, "/f", k, ".py")).when(k % 4 == 2, text("d", k % 7, "/f", k, ".py/inner")).otherwise(text("d", k % 9, "/f", k % 10, "*.py"))
    suites = src.table(spark, d, "supplier").select(k.alias("suite"), entry.alias("entry"))
    return ch.impacted_suites(suites, _recent(spark, d)[0].select("path"))


@query(
    "SELECT rule_id, path, logical, seq FROM (SELECT rule_id, path, 'L' || start_line AS logical, max(seq) AS seq FROM f WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ts >= TIMESTAMP '2024-01-15' AND f.rule_id = x.rule_id AND f.path = x.path AND 'L' || f.start_line = x.logical) AND path IN (SELECT path FROM changed) AND path NOT LIKE 'd4/%'",
    _FINDINGS,
    _COMMITS,
)
def fix_pairs(spark, d):
    f = src.findings(spark, d).withColumn("logical", F.concat(F.lit("L"), F.col("start_line").cast("string")))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    changed = _recent(spark, d)[0].select("path").distinct()
    return ch.fix_pairs(f.filter(early), f.filter(~early), changed, changed.filter("path LIKE 'd4/%'")).select("rule_id", "path", "logical", "seq")


_MERGED = """
r AS (SELECT id, seq, user_id % 3 AS position, 'report' || (user_id % 3) AS report, user_id % 3 < 2 AS newer, CASE k % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'fixed' END AS status, CASE WHEN k % 4 <> 0 THEN k END AS line, 't' || (k % 5) AS tag
  FROM (SELECT seq, substr(rule_id, 1, 9) || repo_id AS id, start_line AS k, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INTEGER) AS user_id FROM f)),
o AS (SELECT *, position * 10000000 + seq AS place FROM r)"""


@query(
    """SELECT id, coalesce(max_by(status, place) FILTER (WHERE newer OR position = 0), min_by(status, place)) AS status, coalesce(max_by(line, place) FILTER (WHERE (newer OR position = 0) AND line IS NOT NULL), arg_min_null(line, place)) AS line,
  array_to_string(list_sort(list_distinct(list(report))), ',') AS sources, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM o GROUP BY id""",
    _FINDINGS,
    _MERGED,
)
def merged_reports(spark, d):
    k, user = F.col("start_line"), F.regexp_extract("path", "f([0-9]+)", 1).cast("int")
    f = src.findings(spark, d).select(
        F.concat(F.substring("rule_id", 1, 9), "repo_id").alias("id"), "seq", (user % 3).alias("position"), F.concat(F.lit("report"), (user % 3).cast("string")).alias("report"), (user % 3 < 2).alias("newer"),
        F.when(k % 3 == 0, "new").when(k % 3 == 1, "existing").otherwise("fixed").alias("status"), F.when(k % 4 != 0, k).alias("line"), F.array(F.concat(F.lit("t"), (k % 5).cast("string"))).alias("tags"),
    )
    return ch.merge_reports(f).select("id", "status", "line", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


_TREE = """
every AS (SELECT p_brand || '/' || p_type || '/' || (p_partkey % 40) || '/' || p_partkey || '.py' AS path, p_type = 'SMALL' OR p_size >= 40 AS test FROM part),
up AS (SELECT path, test, array_to_string(string_split(path, '/')[1:k], '/') AS folder, k FROM every, range(1, 4) t(k)),
pure AS (SELECT folder FROM up GROUP BY 1 HAVING bool_and(test))"""


@query("SELECT DISTINCT coalesce(folder, path) AS path FROM (SELECT e.path, arg_min(u.folder, u.k) AS folder FROM every e LEFT JOIN up u ON u.path = e.path AND u.folder IN (SELECT folder FROM pure) WHERE e.test GROUP BY 1)", _TREE)
def suite_directories(spark, d):
    p = src.table(spark, d, "part")
    path = F.concat_ws("/", "p_brand", "p_type", (F.col("p_partkey") % 40).cast("string"), F.concat(F.col("p_partkey").cast("string"), F.lit(".py")))
    rows = p.select(path.alias("path"), ((F.col("p_type") == "SMALL") | (F.col("p_size") >= 40)).alias("test"))
    return ch.collapse_paths(rows.filter("test").select("path"), rows.select("path"))


@query("SELECT c_custkey AS id, array_to_string(list_filter(['name', 'segment'], lambda x: (x = 'name' AND contains(lower(c_name), '1')) OR (x = 'segment' AND contains(lower(c_mktsegment), 'build'))), ',') AS matched FROM customer WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), 'build')".replace("contains(lower(c_name), '1')", "contains(lower(c_name), 'u')").replace("'build'", "'u'"))
def record_search(spark, d):
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ch.search(c, "U", ["name", "segment"]).select("id", F.array_join("matched", ",").alias("matched"))


@query(
    "SELECT DISTINCT 'order ' || l_orderkey AS id, 'part ' || (l_partkey * 2) AS problem FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'order ' || l_orderkey, 'duplicate id' FROM (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS h FROM lineitem) GROUP BY 1 HAVING count(*) > 1"
)
def registry_problems(spark, d):
    half = F.col("l_suppkey") % 2
    items = src.table(spark, d, "lineitem").groupBy("l_orderkey", half.alias("h")).agg(F.collect_set((F.col("l_partkey") * 2).cast("string")).alias("parts"))
    known = src.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return ch.registry_problems(items.select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("id"), "parts"), [("part", known, "parts")]).distinct()


_ROLES = ["src/main.py", "docs/a.html", ".github/workflows/ci.yml", "infra/main.tf", "dist/app.js", "tests/x_test.go", "web/app.spec.ts", "conf/a.toml", "README.md", "data/blob", "src/test/Foo.java", "package-lock.json", "ui/View.tsx", "c/x.h", "n/P.cs", "k/Main.kt", "css/a.scss", "conf/x.cfg", "bin/run.bash", "e2e/flow.py"]


def _paths(spark, d):
    names = F.array(*[F.lit(x) for x in _ROLES])
    k = F.col("p_partkey")
    path = F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("/"), F.element_at(names, (k % len(_ROLES) + 1).cast("int")))
    rows = src.table(spark, d, "part").select(path.alias("path"), F.col("p_brand").alias("repo"), F.col("p_size").alias("lines"), F.lit(False).alias("binary")).withColumn("language", rc.language(F.col("path")))
    return rows.withColumn("role", rc.role(F.col("path"), F.col("language")))


_ROLED = f"""
p AS (SELECT p_brand AS repo, p_size AS lines, 'pkg' || (p_partkey % 7) || '/' || {_ROLES!r}[p_partkey % {len(_ROLES)} + 1] AS path FROM part),
l AS (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.yml' THEN 'yaml' WHEN path LIKE '%.tf' THEN 'terraform' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.toml' THEN 'toml' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.html' THEN 'html' WHEN path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.h' THEN 'c' WHEN path LIKE '%.cs' THEN 'csharp' WHEN path LIKE '%.kt' THEN 'kotlin' WHEN path LIKE '%.scss' THEN 'css' WHEN path LIKE '%.cfg' THEN 'ini' WHEN path LIKE '%.bash' THEN 'shell' ELSE 'unknown' END AS language FROM p),
r AS (SELECT *, CASE WHEN path LIKE '%.tf' THEN 'iac' WHEN path LIKE '%/dist/%' OR path LIKE '%lock.json' THEN 'generated' WHEN path LIKE '%/.github/workflows/%' THEN 'ci' WHEN path LIKE '%/tests/%' OR path LIKE '%/test/%' OR path LIKE '%.spec.ts' THEN 'test' WHEN path LIKE '%/docs/%' OR path LIKE '%.md' THEN 'docs' WHEN language IN ('yaml', 'json', 'toml', 'ini') THEN 'config' WHEN language = 'unknown' THEN 'data' ELSE 'source' END AS role FROM l)"""


@query("SELECT language, role, count(*) AS files, sum(lines) AS lines FROM r WHERE role <> 'generated' GROUP BY ALL", _ROLED)
def lines_by_role(spark, d):
    return rc.lines_by(_paths(spark, d), "language", "role")


@query(
    "SELECT repo, array_to_string(list_sort(list_distinct(list(s))), ',') AS stacks FROM (SELECT repo, CASE language WHEN 'terraform' THEN 'terraform' WHEN 'typescript' THEN 'typescript' WHEN 'python' THEN 'python' WHEN 'javascript' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'yaml' THEN 'github_actions' END AS s FROM r) GROUP BY 1",
    _ROLED,
)
def repository_stacks(spark, d):
    return rc.stacks(_paths(spark, d), "repo").select("repo", F.array_join("stacks", ",").alias("stacks"))


@query("SELECT DISTINCT path FROM r WHERE path LIKE '%/tests/%' OR path LIKE '%/test/%' OR path LIKE '%/e2e/%' OR path LIKE '%.spec.ts'", _ROLED)
def test_paths(spark, d):
    return _paths(spark, d).select("path").distinct().filter(rc.is_test(F.col("path")))


@query(
    "SELECT reason, n FROM (SELECT 'severity' AS reason, count_if(rank <= 1) AS n FROM g UNION ALL SELECT 'new', count_if(status = 'new' AND rank <= 2) FROM g UNION ALL SELECT 'coverage', CASE WHEN round(sum(run) / sum(applicable), 3) < 0.9 THEN 1 ELSE 0 END FROM card UNION ALL SELECT 'probe_errors', count_if(status = 'error') FROM probes) WHERE n > 0",
    _FINDINGS,
    _BEFORE,
    _PROBES,
    _CARD,
    " g AS (SELECT *, CASE WHEN id IN (SELECT id FROM b) THEN 'existing' ELSE 'new' END AS status FROM f WHERE ts >= TIMESTAMP '2024-01-10' AND confidence <> 'low')",
)
def gate_reasons(spark, d):
    before, after = _halves(spark, d)
    f = fi.baseline_status(after, before).withColumns({"suppressed_by": F.lit(None).cast("int"), "provenance": F.when(F.col("confidence") == "low", "inferred")})
    return fi.gate_reasons(f, _card(spark, d), _probes(spark), "high", "medium", 0.9, True)


@query(
    "SELECT claim, kind, scope, CAST(abstained AS BIGINT) AS abstained FROM (SELECT 'gate' AS claim, 'gate' AS kind, 'partial' AS scope, 2 AS abstained UNION ALL SELECT 'grade', 'grade', CASE WHEN round(sum(run) / sum(applicable), 3) < 0.6 THEN 'withheld' ELSE 'partial' END, 2 FROM card"
    " UNION ALL SELECT 'dimension:' || dimension, 'dimension', CASE WHEN coverage >= 1 AND dimension NOT IN ('quality', 'drift') THEN 'complete' ELSE 'partial' END, CASE WHEN dimension IN ('quality', 'drift') THEN 1 ELSE 0 END FROM card"
    " UNION ALL SELECT 'probe_clean:style', 'probe_clean', 'complete', 0 UNION ALL SELECT 'coverage', 'coverage', 'complete', 0)",
    _FINDINGS,
    _PROBES,
    _CARD,
)
def claim_list(spark, d):
    f = src.findings(spark, d).withColumn("logical", F.lit(""))
    scope = spark.createDataFrame([("full", 5, 5, "")], "mode string, files_read int, files_total int, basis string")
    return fi.claims(f, _probes(spark), _card(spark, d), scope, True)


@query(
    """SELECT id, CASE WHEN o AND t THEN CASE WHEN gap >= 2 THEN 'severity_disagreement' ELSE 'corroborated' END WHEN native OR family IN (SELECT family FROM x WHERE native) THEN 'contested' ELSE 'coverage_gap' END AS bucket, CASE WHEN o AND t AND gap >= 2 THEN gap END AS gap FROM (
  SELECT id, native, family, (SELECT bool_or(y.native) FROM x y WHERE y.repo_id = z.repo_id AND y.path = z.path AND y.family = z.family) AS o, (SELECT bool_or(NOT y.native) FROM x y WHERE y.repo_id = z.repo_id AND y.path = z.path AND y.family = z.family) AS t,
    coalesce((SELECT max(abs(y.rank - z.rank)) FROM x y WHERE y.repo_id = z.repo_id AND y.path = z.path AND y.family = z.family AND y.start_line = z.start_line AND y.native <> z.native), 0) AS gap FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) z)""",
    _FINDINGS,
    " x AS (SELECT *, CASE WHEN rule_id LIKE '%.8' THEN 'eight' ELSE 'f' || (start_line % 3) END AS family, probe IN ('error', 'view') AND rule_id NOT LIKE '%.8' AS native FROM f)",
)
def disagreement_rows(spark, d):
    eight = F.col("rule_id").endswith(".8")
    f = src.findings(spark, d).withColumn("family", F.when(eight, "eight").otherwise(F.concat(F.lit("f"), (F.col("start_line") % 3).cast("string"))))
    return fi.disagreement_rows(f.withColumn("native", F.col("probe").isin("error", "view") & ~eight))


@query(
    """SELECT rule, clean, vulnerable, repos, round(CASE WHEN b = 0 THEN NULL WHEN g = 0 THEN 'inf'::DOUBLE ELSE b / g END, 2) AS ratio,
  CASE WHEN b = 0 OR clean + vulnerable < 5 THEN NULL WHEN g = 0 OR b / g >= 10 THEN CASE WHEN repos < 2 THEN 'low' ELSE 'medium' END WHEN b / g >= 3 THEN 'low' ELSE 'info' END AS severity FROM (
  SELECT rule, clean, vulnerable, repos, CASE WHEN lc > 0 THEN clean * 1000 / lc ELSE 0.0 END AS g, CASE WHEN lv > 0 THEN vulnerable * 1000 / lv ELSE 0.0 END AS b FROM (
    SELECT rule, count_if(population = 'clean') AS clean, count_if(population = 'vulnerable') AS vulnerable, count(DISTINCT repo) AS repos FROM h GROUP BY 1)
  JOIN (SELECT rule, sum(CASE WHEN s.population = 'clean' THEN s.lines END) AS lc, sum(CASE WHEN s.population = 'vulnerable' THEN s.lines END) AS lv FROM (SELECT DISTINCT rule, language FROM h) JOIN s USING (language) GROUP BY 1) USING (rule))""",
    " h AS (SELECT source AS rule, lang AS language, doc_id % 9 AS repo, CASE toxic WHEN 0 THEN 'clean' ELSE 'vulnerable' END AS population, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT language, population, sum(n_chars) AS lines FROM h GROUP BY ALL)",
)
def severity_calibration(spark, d):
    v = src.table(spark, d, "labels").join(src.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    h = v.select(F.col("source").alias("rule"), F.col("lang").alias("language"), (F.col("doc_id") % 9).alias("repo"), F.when(F.col("toxic") == 0, "clean").otherwise("vulnerable").alias("population"), F.col("n_chars").alias("lines"))
    return st.calibrated_severity(h, h.select("language", "population", "lines"))


_WILSON = "greatest(0.0, ({k} / {n} + 1.96 * 1.96 / (2 * {n}) - 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n}))"


@query(
    "SELECT rule_id, detected, missed, clean_pass, false_alarm, round(detected / (detected + missed), 6) AS recall, round("
    + _WILSON.format(k="detected", n="(detected + missed)::DOUBLE")
    + ", 6) AS recall_bound, round(clean_pass / (clean_pass + false_alarm), 6) AS specificity, round("
    + _WILSON.format(k="clean_pass", n="(clean_pass + false_alarm)::DOUBLE")
    + ", 6) AS specificity_bound FROM (SELECT rule_id, count_if(p AND q) AS detected, count_if(p AND NOT q) AS missed, count_if(NOT p AND NOT q) AS clean_pass, count_if(NOT p AND q) AS false_alarm FROM (SELECT source AS rule_id, quality = 1 AS p, n_chars > 900 AS q FROM labels JOIN documents USING (doc_id)) GROUP BY 1) WHERE detected + missed > 0 AND clean_pass + false_alarm > 0"
)
def synthetic_stats(spark, d):
    v = src.table(spark, d, "labels").join(src.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    trials = v.select(F.col("source").alias("rule_id"), (F.col("quality") == 1).alias("planted"), (F.col("n_chars") > 900).alias("fired"))
    return st.synthetic_stats(trials).filter("detected + missed > 0 AND clean_pass + false_alarm > 0")


@query("SELECT rule_id FROM f GROUP BY 1 HAVING count(*) >= 20 AND count_if(ts < TIMESTAMP '2024-01-10') < 20", _FINDINGS)
def newly_proven(spark, d):
    f = src.findings(spark, d)
    count = lambda df: df.groupBy("rule_id").agg(F.count("*").alias("n"))
    return st.newly_proven(count(f.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))), count(f))


@query("SELECT repo_id, path FROM f WHERE rule_id LIKE 'error.%' INTERSECT SELECT repo_id, path FROM f WHERE rule_id LIKE 'click.%'", _FINDINGS)
def shared_paths(spark, d):
    f = src.findings(spark, d)
    return se.common(f.filter("probe = 'error'"), f.filter("probe = 'click'"), ["repo_id", "path"])


@query("SELECT path, title, min(seq) AS seq FROM f GROUP BY ALL", _FINDINGS)
def distinct_titles(spark, d):
    return se.first_order_distinct(src.findings(spark, d), "path", "title", "seq")


@query("SELECT path, rule_id, coalesce(max(CASE WHEN r = 0 THEN seq END), max(seq)) AS seq FROM (SELECT path, rule_id, 0 AS r, max(seq) AS seq FROM f WHERE probe = 'error' GROUP BY ALL UNION ALL SELECT path, rule_id, 1, min(seq) FROM f GROUP BY ALL) GROUP BY ALL", _FINDINGS)
def united_tables(spark, d):
    f = src.findings(spark, d)
    a = f.filter("probe = 'error'").groupBy("path", "rule_id").agg(F.max("seq").alias("seq"))
    return se.united([a, f.groupBy("path", "rule_id").agg(F.min("seq").alias("seq"))], ["path", "rule_id"])


@query(
    "SELECT rule_id, CASE WHEN n = 0 THEN 'unproven' END AS z, CASE WHEN b >= 1 THEN 'exhaustive' WHEN b <= 0 THEN 'unproven' WHEN b <= 0.9 THEN printf('%.1f%%', b * 100) ELSE printf('%.2f%%', b * 100) END AS nines, CAST(ceil(-ln(0.05) / (1.0 / (n + 1))) AS BIGINT) AS needed FROM (SELECT rule_id, count(*) AS n, round(least(0.98, count_if(rank > 1) / count(*)), 6) AS b FROM f GROUP BY 1)".replace("CASE WHEN n = 0 THEN 'unproven' END AS z, ", ""),
    _FINDINGS,
)
def bounds_as_text(spark, d):
    from corvid.functions.scalars import severity_rank

    per = src.findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.round(F.least(F.lit(0.98), F.count_if(severity_rank(F.col("severity")) > 1) / F.count("*")), 6).alias("b"))
    return per.select("rule_id", sc.nines(F.col("b")).alias("nines"), sc.observations_needed(F.lit(1.0) / (F.col("n") + 1)).alias("needed"))


@query(
    "SELECT p_name AS name, 'x' AS key, lower(regexp_replace(substr(p_type, 1, 1), '.', substr(p_type, 1, 1))) AS slug FROM part WHERE false UNION ALL SELECT DISTINCT p_name, p_type, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') FROM part"
)
def slugs(spark, d):
    return src.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("key"), sc.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug")).distinct()


@query("SELECT seq, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'has', 'and', 'not', 'for')))), ',') AS words FROM f", _FINDINGS)
def title_words(spark, d):
    return src.findings(spark, d).select("seq", F.array_join(F.array_sort(sc.token_set(F.col("title"))), ",").alias("words"))


@query()
def ab_compare_full(spark, d):
    f = src.findings(spark, d)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return mt.match(f.filter(early), f.filter(~early))


_TRUTH = [(1, "f8.py", "click", None), (2, None, "event & view", "supply_chain"), (3, None, "view", None), (4, "d1/f8.py", "error", "security"), (5, "no.py", "click", None), (6, None, "nothing", None), (7, None, "view", "supply_chain")]


@query(
    "SELECT item, seq FROM (SELECT item, CASE WHEN len(took) = 0 THEN NULL ELSE took[len(took)] END AS seq FROM steps WHERE item > 0)",
    _FINDINGS,
    f" want(item, path, needles, dimension) AS (VALUES {', '.join(f'({i}, {p!r}, {[x.strip() for x in m.split(chr(38))]!r}, {x!r})' for i, p, m, x in _TRUTH).replace('None', 'NULL')}),"
    " cand AS (SELECT item, f.seq FROM want w, f WHERE (w.path IS NULL OR f.path = w.path OR ends_with(f.path, '/' || w.path)) AND len(list_filter(w.needles, lambda x: contains(lower(f.rule_id || ' ' || f.title || '  '), x))) = len(w.needles) AND (w.dimension IS NULL OR w.dimension = f.dimension)),"
    " steps AS (SELECT 0 AS item, CAST([] AS BIGINT[]) AS took, CAST([] AS BIGINT[]) AS used UNION ALL SELECT s.item + 1, CASE WHEN m IS NULL THEN CAST([] AS BIGINT[]) ELSE [m] END, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END FROM (SELECT s.*, (SELECT min(c.seq) FROM cand c WHERE c.item = s.item + 1 AND NOT list_contains(s.used, c.seq)) AS m FROM steps s WHERE s.item < 7) s)",
    recursive=True,
)
def ground_truth(spark, d):
    f = src.findings(spark, d).withColumns({"description": F.lit(""), "logical": F.lit("")})
    return mt.ground_truth(spark.createDataFrame(_TRUTH, "item int, path string, match string, dimension string"), f)
