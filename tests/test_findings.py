"""Findings: sites, queues, knowledge, claims, matching and change sets on small rows."""

import random

from pyspark.sql import functions as F

from corvid.functions import scalars as s
from corvid.operators import changes as ch
from corvid.operators import findings as fi
from corvid.operators import matching as mt
from corvid.operators import stats as st


def test_sites(spark):
    rows = [
        (1, "a", "r", "p", 3, "One two!", "low"), (2, "b", "r", "p", 3, "one TWO", "critical"), (3, "a", "r", "p", 3, "one two", "high"), (4, "c", "r", "p", 3, "One-Two", "info"), (5, "b", "r", "p", 3, "onetwo", "info"),
        (6, "a", "r", "", 3, "same", "low"), (7, "b", "r", "", 3, "same", "low"), (8, "a", "r", "q", None, "same", "low"), (9, "b", "r", "q", 0, "same", "low"), (10, "a", "r", "p", 4, "one two", "low"),
    ]
    df = spark.createDataFrame(rows, "seq int, probe string, repo_id string, path string, start_line int, title string, severity string")
    got = {r["seq"]: (r["tags"], r["severity"]) for r in fi.merge_sites(df).collect()}
    assert got == {1: (["also:b"], "low"), 3: (["also:c", "also:b"], "high"), **{k: ([], "low") for k in (6, 7, 8, 9, 10)}}


def test_scalars_of_texts(spark):
    c = F.col("x")
    rows = ["see line 12, fixed in 2024: CWE-79", "022", "cwe_79 CWE-79 Cwe 8", "HTTPServer", "a{b, c}d{e,f}", "The Cat-sat on_the 12ab", "x/./y/../z//w.tar.gz", ""]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    out = df.select("x", s.cwe_ids(c).alias("cwe"), s.snake_case(c).alias("snake"), s.braces(c).alias("braces"), s.token_set(c).alias("words"), s.normalised_path(c).alias("path"), s.slug(c).alias("slug"), s.stem(c).alias("stem")).collect()
    got = {r["x"]: r for r in out}
    assert got[rows[0]]["cwe"] == ["CWE-79"] and got["022"]["cwe"] == ["CWE-22"] and got[rows[2]]["cwe"] == ["CWE-79", "CWE-8"] and got[""]["cwe"] == []
    assert got["HTTPServer"]["snake"] == "h_t_t_p_server"
    assert got[rows[4]]["braces"] == ["abd{e,f}", "acd{e,f}"] and got[""]["braces"] == [""]
    assert sorted(got[rows[5]]["words"]) == ["12ab", "cat", "sat"]
    assert got[rows[6]]["path"] == "x/z/w.tar.gz" and got[rows[6]]["stem"] == "w.tar" and got[""]["slug"] == "root" and got[rows[5]]["slug"] == "the-cat-sat-on-the-12ab"
    one = spark.range(1).select(
        s.line_of(F.lit("a\nb\nc"), F.lit(4)), s.nines(F.lit(0.99951)), s.nines(F.lit(0.85)), s.nines(F.lit(1.0)), s.observations_needed(F.lit(1e-6)), s.days_before(F.lit("2024-03-01T10:00"), 2),
        s.is_unknown(F.lit("a.b"), F.array(F.lit("a.b.c"))), s.is_unknown(F.lit("a.b"), F.array(F.lit("a.bc"))), s.truthy(F.lit(" Yes ")), s.truthy(F.lit(None).cast("string")), s.cwe_list(F.array(F.lit("7"), F.lit("CWE-7, cwe 9"))),
    ).first()
    assert list(one) == [3, "99.9510%", "85.0%", "exhaustive", 2995733, "2024-02-28", True, False, True, False, ["CWE-7", "CWE-9"]]
    ids = spark.createDataFrame([("REQ-10",), ("REQ-9",), ("other",), ("ARB-100",)], "x string")
    assert [r["x"] for r in ids.orderBy(s.natural_key(c)).collect()] == ["ARB-100", "REQ-9", "REQ-10", "other"]
    paths = spark.createDataFrame([("a/b.py",), ("b.py",), ("a/x/b.py",), ("a/bcpy",)], "x string")
    fits = lambda *globs: sorted(r["x"] for r in paths.filter(s.any_glob(c, list(globs))).collect())
    assert fits("**/b.py") == ["a/b.py", "a/x/b.py", "b.py"] and fits("a/*") == ["a/b.py", "a/bcpy"] and fits("a/**") == ["a/b.py", "a/bcpy", "a/x/b.py"] and fits("?.py", "a/b?py") == ["a/b.py", "a/bcpy", "b.py"] and fits() == []


def test_review_queue_has_tiers(spark):
    rows = [(k, f"f{k}", rule, repo, path, k, k % 7 == 6) for k, (rule, repo, path) in enumerate((r, p, f) for r in ("new", "started", "proven") for p in ("a", "b") for f in ("x", "x", "y", "z"))]
    df = spark.createDataFrame(rows, "seq int, id string, rule_id string, repo_id string, path string, start_line int, hidden boolean").withColumn("suppressed_by", F.when(F.col("hidden"), 1))
    done = spark.createDataFrame([("f0",)], "id string")
    seen = spark.createDataFrame([("started", 3), ("proven", 20)], "rule_id string, n long")
    got = [(r["rule_id"], r["seq"]) for r in fi.review_queue(df, done, 100, seen).collect()]
    pool = [r for r in rows if not r[6] and r[1] != "f0"]
    want = []
    for tier in (["started", "new"], ["proven"]):
        queues = {}
        for rule in tier:
            by_repo = {}
            for repo in "ab":
                n, listed = {}, []
                for r in sorted((r for r in pool if r[2] == rule and r[3] == repo), key=lambda r: (r[4], r[5])):
                    n[r[4]] = n.get(r[4], 0) + 1
                    listed.append((n[r[4]], r[4], r[0]))
                by_repo[repo] = [x[2] for x in sorted(listed)]
            queues[rule] = [by_repo[p][k] for k in range(9) for p in "ab" if k < len(by_repo[p])]
        want += [(rule, queues[rule][k]) for k in range(20) for rule in tier if k < len(queues[rule])]
    assert got == want
    assert [(r["rule_id"], r["seq"]) for r in fi.review_queue(df, done, 5, seen).collect()] == want[:5]


def test_claims_and_their_violations(spark):
    probe = "name string, status string, applicable boolean, checks int, dimensions array<string>, reason string, finding_count int"
    probes = spark.createDataFrame([("a", "ran", True, 2, ["security"], "", 0), ("b", "skipped", True, 1, ["quality"], " ", 0), ("c", "error", True, 1, ["quality"], "x", 3), ("d", "skipped", False, 1, ["drift"], "Missing binary", 0), ("e", "ran", False, 1, ["drift"], "", 0)], probe)
    f = spark.createDataFrame([("x.not-assessed", "", "p.py", 1), ("y", "", "p.py", None)], "rule_id string, logical string, path string, suppressed_by int")
    card = spark.createDataFrame([("security", 2, 2, 1.0), ("quality", 2, 3, 1.0), ("drift", 1, 0, 1.5)], "dimension string, applicable int, run int, coverage double").withColumn("score", F.lit(50.0))
    card2 = card.withColumn("run", F.when(F.col("dimension") == "quality", 1).otherwise(F.col("run")))
    scope = spark.createDataFrame([("partial", 3, 9, "diff")], "mode string, files_read int, files_total int, basis string")
    names = sorted(r["name"] for r in fi.abstentions(f, probes, scope).collect())
    assert names == ["check:x@p.py", "probe:b", "probe:c", "scan:6 of 9 file(s) not read (diff)"]
    claims = {r["claim"]: (r["scope"], r["abstained"]) for r in fi.claims(f, probes, card2, scope, True).collect()}
    assert claims["gate"] == ("partial", 4) and claims["dimension:security"] == ("partial", 1) and claims["dimension:quality"] == ("partial", 3) and claims["coverage"] == ("complete", 0) and claims["probe_clean:a"] == ("partial", 1)
    bad = spark.createDataFrame([("gate", "gate", "complete", 2), ("dimension:quality", "dimension", "complete", 0), ("coverage", "coverage", "complete", 0)], "claim string, kind string, scope string, abstained long")
    totals = spark.createDataFrame([(0.4, 80.0, True)], "coverage double, overall double, withheld boolean")
    listed = spark.createDataFrame([("probe:b",)], "name string")
    got = {(r["invariant"], r["subject"]) for r in fi.claim_violations(probes, card2, bad, totals, f, listed, True, True).collect()}
    assert got == {("CI-4", "b"), ("CI-5", "quality"), ("CI-5", "drift"), ("CI-7", "c"), ("CI-9", "drift"), ("CI-12", "d"), ("CI-12", "e"), ("CI-1", "gate"), ("CI-1", "dimension:quality"), ("CI-10", "gate"), ("CI-11", "gate"), ("CI-11", "dimension:quality"), ("CI-2", "grade"), ("CI-3", "grade"), ("CI-8", "check:x@p.py")}
    over = card.withColumn("run", F.col("run") + 9)
    assert ("CI-6", "coverage") in {(r["invariant"], r["subject"]) for r in fi.claim_violations(probes, over, findings=f).collect()}
    states = spark.createDataFrame([("1", "satisfied"), ("2", "violated"), ("3", "no_coverage")], "control_id string, state string")
    assert fi.control_coverage(states, 8).first()["assessed"] == 0.25 and fi.control_coverage(states, 8).first()["not_listed"] == 5


def test_matching_like_one_after_the_other(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta eps".split())

    def side(base):
        return [(base + k, f"i{rng.randrange(25)}", rng.choice("rs"), rng.choice(["", "p", "q"]), rng.choice([None, 0, *range(1, 40)]), f"{word()} {word()} {word()}", "x/" + word()) for k in range(60)]

    schema = "seq long, id string, repo_id string, path string, start_line int, title string, rule_id string"
    a, b = side(0), side(100)
    got = sorted(map(tuple, mt.match(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(3)).collect()), key=str)
    tokens = lambda f: {t for t in (f[5] + " " + f[6].split("/")[-1]).split() if len(t) > 2}
    pool, want, left = {}, [], []
    for f in b:
        pool.setdefault(f[1], []).append(f)
    for f in a:
        if pool.get(f[1]):
            want.append(("fingerprint", f[0], pool[f[1]].pop(0)[0]))
        else:
            left.append(f)
    rest = [f for p in pool.values() for f in p]
    for how in ("location", "wording"):
        still = []
        for f in left:
            near = [g for g in rest if g[2] == f[2] and g[3] == f[3]]
            if how == "location":
                hit = next((g for g in near if f[3] and f[4] and g[4] and abs(g[4] - f[4]) <= 2), None)
            else:
                scored = [(len(tokens(f) & tokens(g)) / len(tokens(f) | tokens(g)), g) for g in near]
                best = max((x[0] for x in scored), default=0)
                hit = next((g for x, g in scored if x == best), None) if best >= 0.5 else None
            if hit:
                rest.remove(hit)
                want.append((how, f[0], hit[0]))
            else:
                still.append(f)
        left = still
    want += [("only_a", f[0], None) for f in left] + [("only_b", None, f[0]) for f in rest]
    assert got == sorted(want, key=str) and {h for h, _, _ in want} == {"fingerprint", "location", "wording", "only_a", "only_b"}
    agreed = mt.agreement(spark.createDataFrame(want, "how string, a long, b long")).first()
    assert agreed["agreement"] == round(sum(w[1] is not None and w[2] is not None for w in want) / len(want), 4)


def test_truth_markers_and_recall(spark):
    f = spark.createDataFrame([(1, "r/a", "t one", "d/p.py", "security", 3, 5), (2, "r/b", "t two", "p.py", "quality", 9, None), (3, "r/a", "t three", "xp.py", "security", 1, None)], "seq long, rule_id string, title string, path string, dimension string, start_line int, end_line int").withColumns({"description": F.lit(None).cast("string"), "logical": F.lit("")})
    want = spark.createDataFrame([(1, "p.py", "t", None), (2, None, "r/a & t", "security"), (3, "p.py", "", None), (4, "p.py", "t", None)], "item int, path string, match string, dimension string")
    truth = mt.ground_truth(want, f)
    assert {r["item"]: r["seq"] for r in truth.collect()} == {1: 1, 2: 3, 3: 2, 4: None}
    r = mt.recall_precision(truth, f, True).first()
    assert (r["expected"], r["found"], r["unexpected"], r["recall"], r["precision"]) == (4, 3, 0, 0.75, 1.0) and mt.recall_precision(truth, f, False).first()["precision"] is None
    marks = mt.markers(spark.createDataFrame([("d/p.py", "x\n# expect: r/a, r/c\n\ny # expect: r/a"), ("e.py", None)], "path string, text string"))
    assert sorted(map(tuple, mt.planted(marks, f).collect())) == [("r/a", "d/p.py", 2, "missed"), ("r/a", "d/p.py", 3, "unexpected"), ("r/a", "d/p.py", 4, "caught"), ("r/a", "xp.py", 1, "unexpected"), ("r/c", "d/p.py", 2, "missed")]


def test_knowledge(spark):
    f = spark.createDataFrame([("a", "high", "low", []), ("b", "low", "high", None), ("c", "low", "medium", ["t"])], "rule_id string, severity string, confidence string, tags array<string>")
    stats = spark.createDataFrame([("a", 100, 0), ("b", 12, 8), ("c", 3, 0)], "rule_id string, tp int, fp int")
    got = {r["rule_id"]: (r["severity"], r["confidence"], r["tags"]) for r in st.apply_knowledge(f, spark.createDataFrame([("a", "info"), ("b", "low")], "rule_id string, measured string"), stats).collect()}
    assert got["a"] == ("info", "high", ["severity-was:high", "severity:measured", "precision:1.00", "n=100", "confidence-was:low"])
    assert got["b"] == ("low", "low", ["precision:0.60", "n=20", "confidence-was:high"]) and got["c"] == ("low", "medium", ["t", "precision:1.00", "n=3"])
    wide = spark.createDataFrame([(900, 100, False, None, 40, 9, 1, 3, 26, False, 1, False), (100, 9000, True, None, 0, 0, 1, 0, 0, False, 0, True)], "largest int, lines int, tested boolean, tested_share double, commits int, recent int, files int, failures int, fan_out int, in_cycle boolean, duplicates int, schema boolean")
    assert [(r["score"], r["grade"]) for r in st.maintainability(wide, "module").collect()] == [(3, "E"), (100, "A")]


def test_change_sets(spark):
    known = spark.createDataFrame([("r1", "REQ-1", [], True, 1), ("v1", "REQ-1", ["OLD-1"], False, 2), ("v2", "ARB-2", ["OLD-1", "REQ-9"], False, 3)], "node string, bare string, aliases array<string>, root boolean, seq int")
    assert {r["name"]: r["node"] for r in ch.id_lookup(known).collect()} == {"REQ-1": "r1", "OLD-1": "v1", "ARB-2": "v2", "REQ-9": "v2"}
    f = spark.createDataFrame([(1, "f:aaaaaaaaaaaa", "t1"), (2, "f:bbbbbbbbbbbb", "t2"), (3, "f:cccccccccccc", "t3")], "seq int, id string, title string")
    ledger = spark.createDataFrame([("FAIL-009", "see f:aaaaaaaaaaaa."), ("OTHER-77", None)], "id string, text string")
    assert sorted((r["failure"], r["title"]) for r in ch.draft_ledger(f, f, ledger).collect()) == [("FAIL-010", "t2"), ("FAIL-011", "t3")]
    notes = spark.createDataFrame([("r", "/d/e/", "second", 2), ("r", "d", "first", 1), ("s", "d", "other", 0)], "repo_id string, prefix string, text string, seq int")
    found = spark.createDataFrame([("r", "d/e/x"), ("r", "dx"), ("r", None)], "repo_id string, path string")
    assert {r["path"]: r["scope_note"] for r in ch.scope_notes(found, notes).collect()} == {"d/e/x": "first", "dx": None, None: None}
    rules = spark.createDataFrame([("a/sql.x", None), ("a/b", ["CWE-1"]), ("z", [])], "rule_id string, cwe array<string>")
    assert {r["rule_id"]: r["cwe"] for r in ch.native_cwe(rules, {"a/*": ["CWE-2"], "a/sql*": ["CWE-89"]}).collect()} == {"a/sql.x": ["CWE-89"], "a/b": ["CWE-1"], "z": []}
    assert ch.in_scope(found, spark.createDataFrame([("dx",)], "path string")).count() == 2
    work, cache = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "r")], "key string, result string")
    hits, misses = ch.cache_split(work, cache)
    assert [r["key"] for r in hits.collect()] == ["a"] and [r["key"] for r in misses.collect()] == ["b"]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string").withColumn("k", F.lit(0))
    assert ch.combined_digest(files, ["k"]).first()["digest"] == ch.combined_digest(files.orderBy(F.desc("path")), ["k"]).first()["digest"]
    seen = ch.scan_statistics(spark.createDataFrame([(10, True, True), (30, True, False), (60, False, False)], "lines int, read boolean, changed boolean")).first()
    assert (seen["files_read"], seen["context"], seen["share"]) == (2, 1, 0.4)
