"""Queries on the upkeep of a repository: aliases, renumbered texts, the cache of results, switched-off checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import assurance as asr
from corvid.operators import changes as ch
from corvid.operators import registry as rg
from corvid.operators import rules as ru
from corvid.plans.registry import query
from corvid.sources import records as rc
from corvid.sources.tables import table
from corvid.streaming import cache as ca


@query("SELECT 'A' || c_custkey AS old, CASE WHEN c_custkey // 16 * 16 + 15 <= (SELECT max(c_custkey) FROM customer) THEN 'END' || (c_custkey // 16) ELSE 'A' || ((SELECT max(c_custkey) FROM customer) + 1) END AS new FROM customer")
def alias_ends(spark, d):
    """[I12] Chains of sixteen aliases, followed to their ends."""
    k = F.col("c_custkey")
    aliases = table(spark, d, "customer").select(F.concat(F.lit("A"), k.cast("string")).alias("old"), F.when(k % 16 == 15, F.concat(F.lit("END"), F.floor(k / 16).cast("string"))).otherwise(F.concat(F.lit("A"), (k + 1).cast("string"))).alias("new"))
    return rg.follow_aliases(aliases)


@query(
    """SELECT o_orderkey AS k, 'see C-' || CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) AND xor(o_custkey, 1) <= (SELECT max(c_custkey) FROM customer) THEN xor(o_custkey, 1) ELSE o_custkey END || ', C-x and C-' || o_custkey || 'b.' AS text,
  CAST(o_custkey IN (SELECT c_custkey FROM customer) AND xor(o_custkey, 1) <= (SELECT max(c_custkey) FROM customer) AS INTEGER) AS changes FROM orders"""
)
def swapped_ids(spark, d):
    """[I12] Every even id changes places with the odd one after it, in all texts at once."""
    c = table(spark, d, "customer").select("c_custkey")
    pairs = c.join(c.select(F.col("c_custkey").bitwiseXOR(F.lit(1)).alias("c_custkey")), "c_custkey")
    mapping = pairs.select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("old"), F.concat(F.lit("C-"), F.col("c_custkey").bitwiseXOR(F.lit(1)).cast("string")).alias("new"))
    key = F.col("o_custkey").cast("string")
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("see C-"), key, F.lit(", C-x and C-"), key, F.lit("b.")).alias("text"))
    return rg.replace_ids(texts, "k", mapping)


@query("SELECT o_orderkey AS k, 'REQ-' || o_custkey || ', ARB-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ': x-ARB-001' AS text, 2 + CAST(o_custkey BETWEEN 100 AND 999 AS INTEGER) AS changes FROM orders".replace("'REQ-' || o_custkey", "CASE WHEN o_custkey BETWEEN 100 AND 999 THEN 'ARB-' ELSE 'REQ-' END || o_custkey"))
def renumbered_texts(spark, d):
    """[I12] Ids of three digits under a new prefix."""
    key = F.col("o_custkey")
    text = F.concat(F.lit("REQ-"), key.cast("string"), F.lit(", REQ-"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(": x-REQ-001"))
    return rg.renumber_texts(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text")), "REQ", "ARB")


_CACHE = """
old AS (SELECT event_type AS probe, 'u' || user_id AS key, min(event_id) AS seq FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL),
new AS (SELECT event_type AS probe, 'u' || user_id AS key, min(event_id) AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL),
merged AS (SELECT n.probe, n.key, 1 AS turn, CASE WHEN o.key IS NULL THEN 1 ELSE 0 END AS part, n.seq FROM new n LEFT JOIN old o USING (probe, key) UNION ALL SELECT probe, key, 0, 1, seq FROM old ANTI JOIN new USING (probe, key)),
aged AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY turn, part, seq, key) AS r FROM merged)"""


def _cache_step(spark, d):
    e = table(spark, d, "events").withColumn("early", F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    work = e.filter("NOT early").select(F.col("event_type").alias("probe"), key.alias("key"), F.col("event_id").alias("seq"))
    first = e.filter("early").groupBy(F.col("event_type").alias("probe"), key.alias("key")).agg(F.min("event_id").alias("seq"))
    held = first.select("probe", "key", F.concat(F.lit("r:"), "key").alias("result"), F.lit(0).cast("long").alias("turn"), F.lit(1).alias("part"), "seq")
    most = e.select("user_id").distinct().count() * 3
    return ca.cache_step(held, work, 1, lambda rows: rows.select("probe", "key", F.concat(F.lit("r:"), "key").alias("result")), most)


@query("SELECT probe, key, turn FROM aged QUALIFY row_number() OVER (ORDER BY r, probe) > count(*) OVER () - (SELECT count(DISTINCT user_id) * 3 FROM events)", _CACHE)
def result_cache(spark, d):
    """[I8, Z4] What the cache keeps after a batch: three keys for each user, the oldest of every probe gone in turn."""
    return _cache_step(spark, d).cache.select("probe", "key", F.col("turn").cast("int").alias("turn"))


@query("SELECT probe, n.key, 'r:' || n.key AS result, o.key IS NOT NULL AS hit FROM new n LEFT JOIN old o USING (probe, key)".replace("SELECT probe, n.key", "SELECT n.probe, n.key").replace("USING (probe, key)", "ON n.probe = o.probe AND n.key = o.key"), _CACHE)
def cached_answers(spark, d):
    """[I8] Answers of a batch, from the cache or made anew."""
    return _cache_step(spark, d).answers


#: A part's file by the last digits of its size: its language, ending and text.
_SOURCES = {
    "python": ("source", "x.py", "a = 1  # noqa\nb = '# noqa'\nc = 2  # type: ignore[x]  # the stub of this library is wrong\n"),
    "javascript": ("source", "x.js", "// eslint-disable-next-line no-eval\neval(y) // @ts-ignore\n"),
    "terraform": ("iac", "main.tf", "# checkov:skip=CKV_9 accepted\n# tfsec:ignore:\n"),
    "java": ("source", "vendor/X.java", '@SuppressWarnings("x")\n'),
    "markdown": ("docs", "x.md", "write # noqa\n"),
    "tested": ("test", "test_x.py", "def test_a():\n    run()\n\ndef test_b():\n    assert run()\n\n@unittest.skip\ndef test_c():\n    run()\n"),
    "config": ("config", "setup.cfg", "[flake8]\nexclude = build\n"),
    "ignored": ("data", ".semgrepignore", "# none\nsrc/\n"),
}
_SOURCE_SQL = """
fs AS (SELECT p_partkey AS k, p_brand AS repo_id, p_size % 8 AS form, 'd' || p_partkey || '/' AS d FROM part),
ff AS (
  SELECT 'assurance.blanket-suppression' AS rule, repo_id, d || 'x.py' AS path, 1 AS line, 'ruff/flake8:# noqa' AS evidence FROM fs WHERE form = 0
  UNION ALL SELECT 'assurance.blanket-suppression', repo_id, d || 'x.js', 2, 'typescript:eval(y) // @ts-ignore' FROM fs WHERE form = 1
  UNION ALL SELECT 'assurance.blanket-suppression', repo_id, d || 'main.tf', 2, 'tfsec:# tfsec:ignore:' FROM fs WHERE form = 2
  UNION ALL SELECT 'assurance.suppression-census', repo_id, '', NULL, 'suppressions:' || (2 * count(*)) || ' blanket:' || count(*) || ' unexplained:' || sum(CASE form WHEN 0 THEN 1 ELSE 2 END) FROM fs WHERE form < 3 GROUP BY repo_id
  UNION ALL SELECT 'assurance.test-asserts-nothing', repo_id, d || 'test_x.py', 1, 'no-assertion:test_a' FROM fs WHERE form = 5
  UNION ALL SELECT 'assurance.test-asserts-nothing', repo_id, d || 'test_x.py', 8, 'no-assertion:test_c' FROM fs WHERE form = 5
  UNION ALL SELECT 'assurance.permanently-skipped-test', repo_id, d || 'test_x.py', 7, 'skipped:@unittest.skip' FROM fs WHERE form = 5
  UNION ALL SELECT 'assurance.analysis-excluded', repo_id, d || 'setup.cfg', 2, 'setup.cfg:exclude' FROM fs WHERE form = 6
  UNION ALL SELECT 'assurance.analysis-excluded', repo_id, d || '.semgrepignore', 1, 'semgrep:src/' FROM fs WHERE form = 7)"""


def _sources(spark, d):
    p, form = table(spark, d, "part"), F.col("p_size") % 8
    pick = lambda i: F.element_at(F.array(*[F.lit(([k] if i is None else list(v))[i or 0]) for k, v in _SOURCES.items()]), (form + 1).cast("int"))
    language = F.when(pick(None) == "tested", "python").otherwise(pick(None))
    return p.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/"), pick(1)).alias("path"), pick(0).alias("role"), language.alias("language"), F.lit(3).alias("lines"), pick(2).alias("text"))


@query("SELECT rule, repo_id, path, CAST(line AS INTEGER) AS line, evidence FROM ff", _SOURCE_SQL)
def assurance_findings(spark, d):
    """[R14] Switched-off checks of a repository made of the parts."""
    return asr.assurance_findings(_sources(spark, d), sites=None, tests=None).select("rule", "repo_id", "path", "line", "evidence")


_SECRETS = """
cr AS (SELECT p_size, CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || p_partkey || '.py' AS path FROM part)"""


@query(
    """SELECT path, 2 AS line, 'aws-access-key' AS rule, CASE WHEN p_size % 4 = 0 THEN 'medium' ELSE 'critical' END AS severity, CASE WHEN p_size % 4 = 0 THEN 'low' ELSE 'high' END AS confidence FROM cr WHERE p_size % 3 = 0
UNION ALL SELECT path, 1, 'pg-url', 'low', 'low' FROM cr WHERE p_size % 5 = 0
UNION ALL SELECT path, 3, 'assigned-credential', 'medium', 'low' FROM cr WHERE p_size % 2 = 1""",
    _SECRETS,
)
def credential_findings(spark, d):
    """[R1] Keys and passwords in files made of the parts; half of the names hold something else."""
    p, size = table(spark, d, "part"), F.col("p_size")
    first = F.when(size % 5 == 0, "url = 'postgres://root:root@db/x'").otherwise("x = 1")
    second = F.when(size % 3 == 0, "k = '" + "AKIA" + "ABCDEFGHIJKLMNOP'").otherwise("k = 'AKIA'")
    third = F.when(size % 2 == 0, 'secret_name = "kX9#mQ2$vL7pR4!w"').otherwise('db_password = "kX9#mQ2$vL7pR4!w"')
    path = F.concat(F.when(size % 4 == 0, "tests/").otherwise("src/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    files = p.select(path.alias("path"), F.lit("source").alias("role"), F.lit("python").alias("language"), F.concat_ws("\n", first, second, third).alias("text"))
    return ru.credentials(files).select("path", "line", "rule", "severity", "confidence")


@query(
    """SELECT 'unpinned-python-dep' AS rule, 'r' || p_partkey || '/requirements.txt' AS path, 2 AS line, 'lib' || p_size AS what, 'info' AS severity FROM part WHERE p_size % 3 = 0
UNION ALL SELECT 'unpinned-npm-dep', 'r' || p_partkey || '/package.json', NULL, 'dependencies.m' || p_size, 'info' FROM part WHERE p_size % 3 = 1
UNION ALL SELECT 'unpinned-action', 'r' || p_partkey || '/ci.yml', 2, 'actions/checkout@v' || p_size, 'low' FROM part WHERE p_size % 3 = 2"""
)
def supply_chain_findings(spark, d):
    """[R5] Dependencies without a fixed version, in manifests made of the parts."""
    p, size, form = table(spark, d, "part"), F.col("p_size").cast("string"), F.col("p_size") % 3
    text = F.when(form == 0, F.concat(F.lit("a==1\nlib"), size, F.lit(">=2\n# c"))).when(form == 1, F.concat(F.lit('{"dependencies": {"m'), size, F.lit('": "^1", "q": "1.2.3"}}'))).otherwise(F.concat(F.lit("steps:\n  - uses: actions/checkout@v"), size, F.lit("\n  - uses: a/b@" + "0" * 40)))
    name = F.when(form == 0, "/requirements.txt").when(form == 1, "/package.json").otherwise("/ci.yml")
    files = p.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string"), name).alias("path"), F.when(form == 2, "ci").otherwise("config").alias("role"), text.alias("text"))
    return ru.supply_chain(files).select("rule", "path", "line", "what", "severity")


@query(
    """SELECT 'file-too-long' AS rule, p_brand AS repo_id, 'd' || p_partkey AS path, 'lines=' || (p_size * 20) AS evidence FROM part WHERE p_size * 20 > 800 AND p_size % 4 < 3
UNION ALL SELECT 'todo-density', p_brand, 'd' || p_partkey, 'markers=' || (p_size % 7) FROM part WHERE p_size % 7 >= 5 AND p_size % 4 < 3
UNION ALL SELECT 'no-tests', p_brand, '.', 'source_files=' || count(*) FILTER (p_size % 4 < 2) FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size % 4 < 2) >= 5 AND count(*) FILTER (p_size % 8 = 3) = 0"""
)
def quality_findings(spark, d):
    """[R3] Long files, open marks and repositories without tests, made of the parts."""
    p, size = table(spark, d, "part"), F.col("p_size")
    role = F.when(size % 8 == 3, "test").when(size % 4 == 3, "docs").when(size % 4 == 2, "iac").otherwise("source")
    files = p.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("path"), role.alias("role"), F.when(size % 4 == 2, "terraform").otherwise("go").alias("language"), (size * 20).alias("lines"), F.repeat(F.lit("TODO x\n"), size % 7).alias("text"))
    return ru.quality_findings(files).select("rule", "repo_id", "path", "evidence")


@query("SELECT p_brand AS repo_id, p_partkey AS line, sha1('p' || (p_partkey // 3)) AS hash FROM part WHERE p_partkey % 7 <> 0")
def blamed_lines(spark, d):
    """[S12] Porcelain blame of a file for each brand: a line for each part, three of one commit, each seventh not committed."""
    k = F.col("p_partkey")
    sha = F.when(k % 7 == 0, rc.UNCOMMITTED).otherwise(F.sha1(F.concat(F.lit("p"), F.floor(k / 3).cast("string"))))
    record = F.concat(sha, F.lit(" "), (k + 5).cast("string"), F.lit(" "), k.cast("string"), F.lit(" 1\nauthor x\nsummary y\n\tcode"))
    texts = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_join(F.collect_list(record), "\n").alias("text"))
    return rc.git_blame(texts).select(F.col("path").alias("repo_id"), F.col("line").cast("long").alias("line"), "hash")


@query(
    """SELECT count(*) AS files, count(*) FILTER (c OR x) AS files_read, count(*) FILTER (c) AS changed, count(*) FILTER (x AND NOT c) AS context, sum(lines) AS lines, sum(CASE WHEN c OR x THEN lines ELSE 0 END) AS lines_read, round(sum(CASE WHEN c OR x THEN lines ELSE 0 END) / sum(lines), 4) AS share
FROM (SELECT 3 AS lines, p_size % 8 = 2 OR p_size % 8 = 6 AS x, p_partkey % 5 = 0 OR p_partkey % 5 = 1 AND p_brand = 'Brand#3' AS c FROM part)"""
)
def narrowed_scan(spark, d):
    """[I1, I6] What a partial scan reads of the files made of the parts: every fifth is committed, others of a brand are new."""
    files = _sources(spark, d).withColumn("binary", F.lit(False))
    k = F.regexp_extract("path", "^d([0-9]+)/", 1).cast("long")
    lists = lambda test: files.filter(test).groupBy("repo_id").agg(F.array_join(F.collect_list(F.concat(F.lit("  "), "path")), "\n").alias("text"))
    changed = ch.changed_paths([lists(k % 5 == 0), lists((k % 5 == 1) & (F.col("repo_id") == "Brand#3")), lists(k % 10 == 0)])
    return ch.scan_statistics(ch.narrowed(files, changed))
