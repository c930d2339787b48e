"""Walks, components and answers on small graphs; records read from files."""

import json
import random

from pyspark.sql import functions as F

from corvid.operators import answers as an
from corvid.operators import graphs as g
from corvid.sources import records as rc

NODE = "id string, kind string, name string, file string, directory boolean, test boolean"
EDGE = "source string, target string, type string, provenance string"


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}
        reach = {x: {x} for x in range(40)}
        for _ in range(40):
            for a, b in edges:
                for r in reach.values():
                    if a in r:
                        r.add(b)
        want = {(x, min(y for y in reach[x] if x in reach[y])) for x in range(40) if any(y != x and x in reach[y] for y in reach[x])}
        assert {(r["id"], r["component"]) for r in g.strong_components(spark.createDataFrame(list(edges), "source long, target long")).collect()} == want
    assert g.strong_components(spark.createDataFrame([(1, 1), (1, 2)], "source long, target long")).count() == 0


def test_lineage_limits_and_single_hops(spark):
    nodes = spark.createDataFrame([(x, "external" if x == "x" else "commit" if x in "cd" else "module", x, "", False, False) for x in "abcdefghix"], NODE)
    edges = spark.createDataFrame([("a", "b", "contains", "E"), ("b", "e", "defines", "E"), ("a", "f", "touches", "E"), ("f", "g", "contains", "E"), ("c", "d", "follows", "E"), ("c", "f", "modifies", "E"), ("a", "x", "touches", "E"), ("h", "a", "delivers", "E"), ("h", "i", "modifies", "E")], EDGE)
    rows = {r["id"]: (r["hops"], r["via"], r["listed"]) for r in g.lineage(nodes, edges, "a").collect()}
    assert rows == {"b": (1, "contains", True), "f": (1, "touches", True), "h": (1, "delivers", True), "e": (2, "defines", True), "i": (2, "modifies", True)}  # not g: f was reached by another edge
    assert {r["id"] for r in g.lineage(nodes, edges, "d", "down").collect()} == {"c"} and {r["id"] for r in g.lineage(nodes, edges, "c", "up").collect()} == {"d"}
    few = {r["id"]: r["listed"] for r in g.lineage(nodes, edges, "a", limit=2).collect()}
    assert few == {"b": True, "f": True, "h": False, "e": False}  # i is only reached from h
    listed = g.lineage(nodes, edges, "c", "down")
    assert {(r["source"], r["target"]) for r in g.lineage_edges(edges, listed, "c").collect()} == {("c", "f")}


def test_impact_folds_tests_and_stops_at_hubs(spark):
    nodes = spark.createDataFrame([("d", "file", "d", "src", True, False), ("m", "module", "m", "src/m.py", False, False), ("t", "module", "t", "t/t.py", False, True), ("t1", "function", "t1", "t/t.py", False, True), ("f1", "finding", "f1", "", False, False), ("f2", "finding", "f2", "", False, False), ("r", "finding_rule", "R1", "", False, False), ("x", "failure", "x", "", False, False), ("c9", "cwe", "CWE-9", "", False, False), ("q", "requirement", "q", "", False, False)], NODE)
    edges = spark.createDataFrame([("f1", "m", "flags", ""), ("f1", "r", "violates", ""), ("f2", "r", "violates", ""), ("t1", "x", "guards", ""), ("x", "m", "affects", ""), ("q", "d", "touches", ""), ("t", "m", "verifies", ""), ("f2", "c9", "classified_as", "")], EDGE)
    run = lambda *paths: {(r["bucket"], r["id"], r["hops"]) for r in g.impact(nodes, edges, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert run("./src/m.py") == {("findings", "f1", 1), ("failures", "x", 1), ("requirements", "q", 1), ("tests", "t", 1)}
    assert run("R1") == {("findings", "f1", 1), ("findings", "f2", 1), ("files", "m", 2)}
    assert run("cwe_9") == {("findings", "f2", 1)} and run("nowhere.py") == set()


def test_small_graph_operators(spark):
    links = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "d", 5), ("c", "d", 7), ("d", "a", 1)], "user string, used string, n long")
    assert {(r["level"], r["component"], r["n"]) for r in g.component_trace(links, "a").collect()} == {(1, "b", 2), (1, "c", 1), (2, "d", 5)}
    assert {(r["level"], r["component"]) for r in g.component_trace(links, "d", up=True, depth=1).collect()} == {(1, "b"), (1, "c")}
    bases = spark.createDataFrame([("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "A", 0)], "class string, base string, place int")
    methods = spark.createDataFrame([("D", "m"), ("C", "m"), ("C", "k")], "class string, name string")
    wanted = spark.createDataFrame([("A", "m"), ("A", "k"), ("A", "none"), ("D", "m")], "class string, name string")
    assert {(r["class"], r["name"], r["owner"]) for r in g.inherited(bases, methods, wanted).collect()} == {("A", "m", "D"), ("A", "k", "C"), ("D", "m", "D")}
    ents = spark.createDataFrame([("1", "UserBox", None), ("2", "Order", None), ("3", "X", "Users"), ("4", "Y", "none")], "id string, name string, explicit string")
    tables = spark.createDataFrame([("user_boxes",), ("orders",), ("order_s",), ("users",)], "name string")
    assert {r["id"]: r["table"] for r in g.entity_tables(ents, tables).collect()} == {"1": "user_boxes", "2": "orders", "3": "users"}
    nodes = spark.createDataFrame([("t", "module", "t", "t.py", False, True), ("t.f", "function", "f", "t.py", False, True), ("t.g", "function", "g", "t.py", False, True), ("m", "module", "m", "m.py", False, False), ("e", "external", "e", "", False, False), ("o", "external", "o", "", False, False)], NODE)
    edges = spark.createDataFrame([("t.f", "m", "calls", "EXTRACTED"), ("t.g", "m", "uses", "EXTRACTED"), ("t", "m", "imports", "EXTRACTED"), ("t.f", "t.g", "calls", "EXTRACTED"), ("m", "e", "imports", "EXTRACTED"), ("m", "o", "calls", "EXTRACTED")], EDGE)
    assert [tuple(r) for r in g.derived_verifies(nodes, edges).collect()] == [("t", "m", 3, ["f", "g"])]
    left, kept = g.prune_externals(nodes, edges, spark.createDataFrame([("m", "o", "calls")], "source string, target string, type string"))
    assert kept.count() == 5 and "o" not in {r["id"] for r in left.collect()} and left.count() == 5
    assert an.why(nodes, edges, "m").filter("section = 'gaps'").count() == 1 and an.neighbourhood(nodes, edges, "zz").count() == 0
    points = spark.createDataFrame([("f", k) for k in (0, 5, 99, 5000, 70000)], "file string, line long")
    spans = spark.createDataFrame([("f", 0, 10, "a"), ("f", 5, 5, "b"), ("f", 4, 6000, "c"), ("f", 0, 65000, "d"), ("g", 0, 9, "e")], "file string, start long, end long, name string")
    assert {r["line"]: r["name"] for r in g.innermost(points, spans).collect()} == {0: "a", 5: "b", 99: "c", 5000: "c", 70000: None}


def test_records_from_files(spark, tmp_path):
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/a.json").write_text(json.dumps({"items": [{"key": " R-1 ", "summary": "s", "state": "open", "paths": ["x", "y"]}, {"id": "", "title": "none"}, {"number": 7, "scope": "z"}]}))
    (tmp_path / "reg/b.json").write_text(json.dumps([{"id": "R-1", "title": "later"}, {"req": "R-2", "title": "t", "affected_files": []}]))
    (tmp_path / "reg/c.json").write_text("{broken")
    got = {r["id"]: (r["title"], r["status"], r["scope"]) for r in rc.requirements(spark, str(tmp_path / "reg")).collect()}
    assert got == {"R-1": ("s", "open", ["x", "y"]), "7": ("", None, ["z"]), "R-2": ("t", None, [])}
    (tmp_path / "led.json").write_text(json.dumps({"failures": [{"id": "F-1", "affected": ["a.py"], "fix_commits": ["c"]}]}))
    assert rc.failures(spark, str(tmp_path / "led.json")).first()["affected"] == ["a.py"]
    (tmp_path / "pack.json").write_text(json.dumps({"rules": [{"id": "r", "severity": "required", "validation": {"type": "co_changed", "when_changed": ["**"]}}]}))
    assert rc.rules(spark, str(tmp_path / "pack.json")).first()["validation"]["when_changed"] == ["**"]
    (tmp_path / "su.json").write_text(json.dumps({"suites": [{"id": "s", "paths": ["t"]}]}))
    assert rc.suites(spark, str(tmp_path / "su.json")).first()["paths"] == ["t"]
    (tmp_path / "rep.json").write_text(json.dumps({"started_at": "2024", "findings": [{"id": "f:1", "tags": ["a"], "location": {"path": "x\\y.py", "start_line": 3}}]}))
    r = rc.reports(spark, str(tmp_path / "rep.json")).first()
    assert (r["id"], r["path"], r["start_line"], r["started_at"], r["tags"]) == ("f:1", "x/y.py", 3, "2024", ["a"])
    (tmp_path / "h").mkdir()
    (tmp_path / "h/history.jsonl").write_text('{"time": "2024-01-01T01:00:00", "findings_total": 3, "score": 9.5, "counts": {"high": 2}}\n{bad\n\n{"score": 1}\n')
    rows = rc.history(spark, str(tmp_path / "h"))
    assert [(x["time"], x["counts"]["high"]) for x in rows.collect()] == [("2024-01-01T01:00:00", 2)]
    rc.append_history(rows, str(tmp_path / "h"))
    day = rc.trend(rc.history(spark, str(tmp_path / "h"))).first()
    assert (day["runs"], day["findings"], day["lowest"]) == (2, 6, 9.5)
    q = rc.trend(rc.history_stream(spark, str(tmp_path / "h"))).writeStream.format("memory").queryName("trend").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("trend").first()["runs"] == 2
    (tmp_path / "log").write_text("\x1eabc\x1fp1 p2\x1f2024-01-02\x1fsubject\x1fbody\nmore\x1f\nx.py\ny.py\n\x1e\x1f\x1f")
    c = rc.git_log(spark, str(tmp_path / "log")).collect()
    assert [(x["hash"], x["parents"], x["subject"], x["body"], x["files"]) for x in c] == [("abc", ["p1", "p2"], "subject", "body\nmore", ["x.py", "y.py"])]
    log = "# Changes\n\n## [Unreleased]\n- one\n  more\n```\n## 2020-01-01\n- code\n```\n- two\n### 2024-02-03 (2) (Title)\ntext\n## [1.2.0] - 2024-01-01\n* three\n"
    docs = spark.createDataFrame([("c.md", log), ("e.md", "no heading"), ("n.md", None)], "path string, text string")
    assert [(x["start"], x["end"], x["date"], x["version"]) for x in rc.changelog(docs).orderBy("start").collect()] == [(3, 12, None, None), (13, 15, "2024-01-01", "1.2.0")]
    assert [(x["start"], x["end"]) for x in rc.bullets(docs).orderBy("start").collect()] == [(4, 9), (10, 10), (14, 15)]
    src = tmp_path / "repo"
    for name, data in {"a.py": b"x\r\ny", "b.bin": b"a\0b", "u.txt": "﻿hi\n".encode("utf-16-le"), ".git/x": b"z", "k.yaml": b"apiVersion: 1\nkind: x\n", "docs/r.md": "﻿# t\n".encode()}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    inv = {x["path"]: x for x in rc.inventory(spark, str(src)).collect()}
    assert set(inv) == {"a.py", "b.bin", "u.txt", "k.yaml", "docs/r.md"} and inv["a.py"]["text"] == "x\ny" and inv["a.py"]["lines"] == 2 and inv["b.bin"]["binary"] and inv["u.txt"]["text"].strip("﻿") == "hi\n" and inv["docs/r.md"]["text"] == "# t\n"
    assert {p: x["role"] for p, x in inv.items()} == {"a.py": "source", "b.bin": "data", "u.txt": "data", "k.yaml": "config", "docs/r.md": "docs"}
    assert rc.stacks(rc.inventory(spark, str(src)).withColumn("repo", F.lit("r")), "repo").first()["stacks"] == ["kubernetes", "python"]


def test_why_follows_tests_and_failures(spark):
    nodes = spark.createDataFrame([("m", "module", "m", "a/m.py", False, False), ("f", "function", "f", "a/m.py", False, False), ("a", "file", "a", "a", True, False), ("t", "module", "t", "t.py", False, True), ("s", "suite", "s", "", False, False), ("x", "failure", "x", "", False, False), ("r", "rule", "r", "", False, False), ("q", "requirement", "q", "", False, False), ("w", "requirement", "w", "", False, False), ("l", "changelog", "l", "", False, False), ("l2", "changelog", "l2", "", False, False)], NODE)
    edges = spark.createDataFrame([("m", "f", "defines", "E"), ("q", "m", "touches", "E"), ("w", "a", "touches", "E"), ("l", "q", "records", "E"), ("l2", "w", "records", "E"), ("t", "f", "verifies", "E"), ("s", "t", "contains", "E"), ("x", "f", "affects", "E"), ("x", "r", "prevented_by", "E"), ("t", "x", "guards", "E"), ("l2", "m", "mentions", "E")], EDGE)
    got = lambda name: {(r["section"], r["id"], r["via"]) for r in an.why(nodes, edges, name).collect()}
    scope = {("requirements", "w", "directory scope a"), ("tests", "t", ""), ("test suites", "s", ""), ("failures", "x", ""), ("rules and playbooks from those failures", "r", ""), ("changelog", "l2", "names this file"), ("changelog", "l", "")}
    assert got("m") == scope | {("requirements", "q", "declared scope")}
    assert got("f") == scope | {("requirements", "q", "declared scope (containing file)")}
    assert got("x") == {("affected code", "f", ""), ("prevented by", "r", ""), ("regression tests", "t", "")}


def test_stacked_diamonds_stay_small(spark):
    from corvid.operators import graphs as g

    # Each class has two bases that share one: 2 ** 14 ways lead to the top, on each level one goes on.
    bases = []
    for k in range(14):
        bases += [(f"c{k}", f"l{k}", 0), (f"c{k}", f"r{k}", 1), (f"l{k}", f"c{k + 1}", 0), (f"r{k}", f"c{k + 1}", 0)]
    methods = [("c14", "top"), ("r3", "side"), ("c9", "side")]
    out = g.inherited(spark.createDataFrame(bases, "class string, base string, place int"), spark.createDataFrame(methods, "class string, name string"), spark.createDataFrame([("c0", "top"), ("c0", "side"), ("c0", "none")], "class string, name string"))
    assert {(r["name"], r["owner"]) for r in out.collect()} == {("top", "c14"), ("side", "c9")}


def test_long_chains(spark):
    from corvid.operators import graphs as g

    n = 70
    chain = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(n)], "source string, target string")
    ring = chain.union(spark.createDataFrame([(f"n{n:03}", "n000")], "source string, target string"))
    assert g.closure(chain).count() == n * (n + 1) // 2
    assert {(r["id"], r["component"]) for r in g.strong_components(ring).collect()} == {(f"n{k:03}", "n000") for k in range(n + 1)}
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(n + 1)], "id string")
    path = g.trace(nodes, chain, "n000", "n036").orderBy("hops").collect()
    assert [(r["id"], r["hops"]) for r in path] == [(f"n{k:03}", k) for k in range(37)]
    assert g.trace(nodes, chain.limit(2), "n000", "n036").count() == 0
