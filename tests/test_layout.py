"""Imports, workspaces, components, rule traces and tool outputs on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from corvid.operators import layout as lo
from corvid.operators import tracing as tr
from corvid.sources import reports as rp


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def targets(spark, files, imports, declared=()):
    modules = frame(spark, [(f,) for f in files], "path string")
    rows = frame(spark, [(p, "python" if p.endswith(".py") else "javascript", raw) for p, raw in imports], "path string, language string, raw string")
    out = lo.resolve_imports(rows, modules, frame(spark, list(declared), "folder string, roots array<string>"))
    got = {(r["path"], r["raw"]): r["target"] for r in out.collect()}
    return [got[i] for i in imports]


def test_python_imports(spark):
    files = ["a/pkg/__init__.py", "a/pkg/m.py", "a/pkg/sub/__init__.py", "a/pkg/sub/n.py", "a/src/lib.py", "b/lib.py", "lib.py", "main.py", "a/tests/t.py", "x/deep/y/z.py", "vendor/y/w.py", "__init__.py"]
    cases = [
        ("a/pkg/m.py", "pkg.sub.n", "a/pkg/sub/n.py"),  # the first directory up that is no package
        ("a/pkg/sub/n.py", "pkg.sub", "a/pkg/sub/__init__.py"),
        ("a/tests/t.py", "lib", "a/src/lib.py"),  # src/ beside an ancestor goes before that ancestor and the top
        ("b/lib.py", "lib", "b/lib.py"),
        ("main.py", "lib", "lib.py"),
        ("a/pkg/sub/n.py", ".", "a/pkg/sub/__init__.py"),
        ("a/pkg/sub/n.py", "..m", "a/pkg/m.py"),
        ("a/pkg/sub/n.py", "...pkg", "a/pkg/__init__.py"),
        ("a/pkg/sub/n.py", ".....lib", "lib.py"),  # above the top stays there
        ("a/pkg/sub/n.py", "nowhere.x", None),
        ("a/pkg/sub/n.py", "", None),
        ("x/deep/y/z.py", "y.w", "vendor/y/w.py"),  # declared at the top
    ]
    assert targets(spark, files, [(p, raw) for p, raw, _ in cases], [("", ["vendor"]), ("b", [])]) == [t for *_, t in cases]


def test_script_imports(spark):
    files = ["w/app.ts", "w/view.tsx", "w/m.mts", "w/real.js", "w/both.js", "w/both.ts", "w/dir/index.ts", "w/data.json", "top.ts", "w/.js.ts"]
    cases = [
        ("w/x.ts", "./app.js", "w/app.ts"), ("w/x.ts", "./view.js", "w/view.tsx"), ("w/x.ts", "./view.jsx", "w/view.tsx"), ("w/x.ts", "./m.mjs", "w/m.mts"), ("w/x.ts", "./real.js", "w/real.js"),
        ("w/x.ts", "./both.js", "w/both.ts"), ("w/x.ts", "./both", "w/both.ts"), ("w/x.ts", "./dir", "w/dir/index.ts"), ("w/x.ts", "./data.json", "w/data.json"), ("w/x.ts", "../top", "top.ts"), ("w/x.ts", "../../top", None),
        ("w/x.ts", "react", None), ("w/x.ts", "./gone", None), ("w/x.ts", "./.js", "w/.js.ts"),
    ]
    assert targets(spark, files, [(p, raw) for p, raw, _ in cases]) == [t for *_, t in cases]


def test_nested_workspaces(spark):
    files = frame(spark, [(p,) for p in ("a/.m/v.json", "a/b/.m/v.json", "a/b/c/.m/v.json", "node_modules/x/.m/v.json", ".m/v.json", "ab/.m/v.jsonx")], "path string")
    roots = lo.workspace_roots(files, ".m/v.json", ["node_modules"])
    assert sorted(r[0] for r in roots.collect()) == ["a", "a/b"]
    paths = frame(spark, [("a/x.py",), ("a/b/c/y.py",), ("ab/z.py",), ("top.py",), ("a",)], "path string")
    assert {r["path"]: r["workspace"] for r in lo.with_workspace(paths, roots).collect()} == {"a/x.py": "a", "a/b/c/y.py": "a/b", "ab/z.py": "", "top.py": "", "a": ""}


def test_records_of_workspaces_have_ids_of_their_own(spark):
    records = frame(spark, [("", "requirement", "R1", []), ("ws", "requirement", "R1", ["OLD"]), ("ws", "requirement", "OLD2", ["R1x"]), ("ws", "requirement", "R3", ["OLD2"]), ("", "rule", "G", None), ("ws", "failure", "F", [])], "workspace string, kind string, id string, aliases array<string>")
    links = [("ws", "failure", "F", "requirement", "OLD", "arose_in"), ("ws", "failure", "F", "requirement", "OLD2", "arose_in"), ("ws", "failure", "F", "rule", "G", "prevented_by"), ("ws", "failure", "F", "rule", "gone", "prevented_by"), ("", "requirement", "R1", "rule", "G", "uses"), ("", "failure", "F", "rule", "G", "uses")]
    nodes, edges = lo.qualify_records(records, frame(spark, links, "workspace string, source_kind string, source string, target_kind string, target string, type string"))
    assert sorted(r["id"] for r in nodes.collect()) == ["failure:ws/F", "requirement:R1", "requirement:ws/OLD2", "requirement:ws/R1", "requirement:ws/R3", "rule:G"]
    assert sorted(map(tuple, edges.collect())) == [("failure:ws/F", "requirement:ws/OLD2", "arose_in"), ("failure:ws/F", "requirement:ws/R1", "arose_in"), ("failure:ws/F", "rule:G", "prevented_by"), ("requirement:R1", "rule:G", "uses")]


def grouped(spark, paths, split_at=25):
    return {r["path"]: (r["application"], r["component"], r["place"]) for r in lo.group_modules(frame(spark, [(p, p) for p in paths], "id string, path string"), split_at).collect()}


def test_components_skip_what_all_share_and_divide_large_directories(spark):
    paths = [f"web/src/main/java/com/acme/{x}/F{k}.java" for x, n in (("api", 3), ("db", 2)) for k in range(n)] + ["web/src/main/java/com/acme/Main.java"]
    got = grouped(spark, paths)
    base = "web/src/main/java/com/acme"
    assert got[f"{base}/api/F0.java"] == ("web", f"{base}/api", f"{base}/api") and got[f"{base}/Main.java"] == ("web", f"{base} (files)", base)
    # The shared prefix ends at a module that lies in it.
    assert grouped(spark, ["p/src/a/x.py", "p/src/a/b/y.py", "p/src/a/b/z.py"])["p/src/a/b/y.py"][1] == "p/src/a/b"
    # A large directory is divided once it has two directories; the files beside them are a component.
    many = [f"p/big/{x}/f{k}.py" for x in "ab" for k in range(3)] + ["p/big/one.py", "p/small/f.py"] + [f"p/deep/only/f{k}.py" for k in range(6)]
    got = grouped(spark, many, 4)
    assert {v[1] for v in got.values()} == {"p/big/a", "p/big/b", "p/big (files)", "p/small", "p/deep"}
    assert grouped(spark, ["setup.py", "x.py"]) == {p: ("(root)", "(root)", "(root)") for p in ("setup.py", "x.py")}
    assert grouped(spark, ["tool/run.py", "tool/go.py"])["tool/run.py"] == ("tool", "tool", "tool")
    assert grouped(spark, ["tool/run.py", "tool/x/go.py"])["tool/run.py"][1] == "tool (files)"
    assert grouped(spark, []) == {}


def brute_components(paths, threshold):
    """By recursion over one application's modules under one root."""
    out, dirs = {}, {p: p.split("/")[:-1] for p in paths}
    depth = 1
    while all(len(d) > depth for d in dirs.values()) and len({d[depth] for d in dirs.values()}) == 1:
        depth += 1

    def assign(members, depth):
        buckets, loose = {}, []
        for p in members:
            if len(dirs[p]) > depth:
                buckets.setdefault("/".join(dirs[p][: depth + 1]), []).append(p)
            else:
                loose.append(p)
        for place, items in buckets.items():
            if len(items) > threshold and len({dirs[p][depth + 1] for p in items if len(dirs[p]) > depth + 1}) >= 2:
                assign(items, depth + 1)
            else:
                out.update(dict.fromkeys(items, place))
        out.update({p: "/".join(dirs[p]) + (" (files)" if buckets else "") for p in loose})

    assign(paths, depth)
    return out


@pytest.mark.parametrize("threshold", [1, 3, 10])
def test_components_are_those_of_a_recursion(spark, threshold):
    import random

    rng = random.Random(threshold)
    paths = sorted({"app/" + "".join(f"{rng.choice('xyz')}/" for _ in range(rng.randint(0, 4))) + f"f{k}.py" for k in range(120)})
    assert {p: v[1] for p, v in grouped(spark, paths, threshold).items()} == brute_components(paths, threshold)


def test_roles_and_edges(spark):
    g = frame(spark, [("m1", "a", "a/api", "a/api"), ("m2", "a", "a/xyz", "a/services/xyz"), ("m3", "b", "b/thing", "b/thing"), ("m4", "b", "b/thing", "b/thing"), ("m5", "b", "b/q", "b/q")], "id string, application string, component string, place string")
    kinds = frame(spark, [("m3", "entity"), ("m4", "controller"), ("m2", None)], "id string, stereotype string")
    assert {r["component"]: r["role"] for r in lo.component_roles(g, kinds).collect()} == {"a/api": "services", "a/xyz": "services", "b/thing": "api-endpoints", "b/q": "module-group"}
    links = frame(spark, [("m1", "m2"), ("m1", "m2"), ("m1", "m3"), ("m1", "m4"), ("m3", "m4"), ("m3", "m1"), ("m3", "gone")], "source string, target string")
    depends = {(r["source"], r["target"], r["n"]) for r in lo.component_edges(g, links).filter("type = 'depends_on'").collect()}
    assert depends == {("component:a/api", "component:a/xyz", 1), ("component:a/api", "component:b/thing", 2), ("component:b/thing", "component:a/api", 1), ("application:a", "application:b", 2), ("application:b", "application:a", 1)}


def test_names_and_ids_in_texts(spark):
    one = spark.createDataFrame([("see pack/quality.no-tests, x.y.; a.b/c. (d.e) .f -g h.i.j",)], "t string")
    got = set(one.select(tr.names_in(F.col("t"))).first()[0])
    assert {"pack/quality.no-tests", "pack", "x.y", "x.y.", "a.b", "a.b/c", "d.e", "h.i.j"} <= got and not {"h.i", "quality.no-tests", "no-tests", "f", "g", "e"} & got
    ids = spark.createDataFrame([("ARB-048, XARB-048x ARB-0481 (ARB-1-) A_B-2/ARB-3",)], "t string").select(tr.ids_in(F.col("t"))).first()[0]
    assert ids == ["ARB-048", "XARB-048x", "ARB-0481", "ARB-1-", "ARB-1", "A_B-2", "ARB-3"]
    assert spark.createDataFrame([("`a.b-\n  c` and `x` ``",)], "t string").select(tr.spans(F.col("t"))).first()[0] == ["a.b-c", "x"]


def test_rules_are_traced_by_the_first_record_that_counts(spark):
    rules = frame(spark, [("r:1", "acme/q.one"), ("r:2", "acme/q.two"), ("r:3", "acme/p.x")], "id string, name string")
    requirements = frame(spark, [("req:R-1", "", "R-1", ["OLD-1"]), ("req:ws/R-1", "ws", "R-1", []), ("req:ws/R-2", "ws", "R-2", [])], "id string, workspace string, name string, aliases array<string>")
    reported = frame(spark, [("r:1", "ws/R-2", "rep.json"), ("r:1", "OLD-1", None), ("r:9", "R-1", None), ("r:1", "nothing", None)], "rule string, requirement string, report string")
    bullets = frame(spark, [("", "CHANGELOG.md", 5, "- OLD-1 | `q.one` and `acme/q.\n  two`, not R-2"), ("ws", "ws/C.md", 2, "- R-2 uses `./packs/{q,none}.yaml` and `q.two.`"), ("ws", "ws/C.md", 9, "- nothing here q.one")], "workspace string, path string, start int, text string")
    entries = frame(spark, [("c:1", "CHANGELOG.md", 1, 9), ("c:2", "ws/C.md", 1, None)], "id string, path string, start int, end int")
    registry = frame(spark, [("ws", "ws/r.json", "R-1", "checks p.x, and q.ones"), ("ws", "ws/r.json", "R-9", "p.x")], "workspace string, path string, name string, text string")
    packs = frame(spark, [("ws", "ws/src/tool/packs/q.yaml", "# see (R-1) R-2x", ["acme/q.one", "acme/q.two", "acme/q.gone"]), ("", "src/packs/p.yaml", "# R-1", ["acme/p.x"])], "workspace string, path string, header string, rules array<string>")
    edges = tr.trace_rules(rules, requirements, reported, bullets, entries, registry, packs, "acme/")
    got = {(r["source"], r["target"]): (r["how"], r["token"], r["place"]) for r in edges.filter("type = 'specified_by'").collect()}
    assert got == {
        ("r:1", "req:ws/R-2"): ("report", "acme/q.one", "rep.json"), ("r:1", "req:R-1"): ("report", "acme/q.one", "the report"), ("r:2", "req:R-1"): ("changelog", "acme/q.two", "CHANGELOG.md:5"),
        ("r:2", "req:ws/R-2"): ("changelog", "q.two", "ws/C.md:2"), ("r:3", "req:ws/R-1"): ("requirements-registry", "p.x", "ws/r.json (R-1)"),
        ("r:1", "req:ws/R-1"): ("rule-pack", "acme/q.one", "ws/src/tool/packs/q.yaml (header)"), ("r:2", "req:ws/R-1"): ("rule-pack", "acme/q.two", "ws/src/tool/packs/q.yaml (header)"),
    }
    assert {(r["source"], r["target"], r["token"]) for r in edges.filter("type = 'mentions_rule'").collect()} == {("c:1", "r:1", "q.one"), ("c:1", "r:2", "acme/q.two")}
    violates = frame(spark, [("f1", "r:2"), ("f2", "r:3"), ("f3", "r:9")], "finding string, rule string")
    assert {r["finding"]: r["traced_to"] for r in tr.traced_findings(violates, edges, requirements).collect()} == {"f1": ["R-1", "R-2"], "f2": ["R-1"]}


def test_selectors(spark):
    doc = {"a": [{"b": [1, 2]}, {"b": 3}, {"c": 4}, 5], "d": {"e": {"f": "x"}}, "n": None, "l": [[7], 8]}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").withColumn("v", F.parse_json("t"))
    cases = {"$": [doc], "$.a.b": [1, 2, 3], "$.a[0].b": [1, 2], "$.a[0].b[*]": [1, 2], "$.a[1].b[*]": [], "$.d.e": [{"f": "x"}], "$.d.e[*]": [], "$.n": [], "$.x.y": [], "$.a[9]": [], "$.d.e.f": ["x"], "$.l[0]": [7], "$.l.x": []}
    for selector, want in cases.items():
        assert json.loads(df.select(F.to_json(F.to_variant_object(rp.selected(F.col("v"), selector)))).first()[0]) == want, selector
    dig = {"a[0].b[1]": "2", "a.1.b": "3", "d.e.f": "x", "n": None, "a.7": None, "": None, "a[0].b.x": None}
    row = df.select(*[F.try_variant_get(rp.dug(F.col("v"), p), "$", "string").alias(f"c{i}") for i, p in enumerate(dig)]).first()
    assert list(row) == list(dig.values())


def test_tool_outputs(spark):
    texts = [("plain", '[{"x":1},{"x":2}]'), ("banner", 'v1.2 ready\n{"r":[{"x":3}]}'), ("empty", "  "), ("none", None), ("broken", "oops {"), ("many", '[{"r":[{"x":4}]},{"r":{"x":5}},6]')]
    df = frame(spark, texts, "tool string, text string")
    rows = lambda sel: sorted((r["tool"], r["place"], r["row"]) for r in rp.tool_rows(df, sel).select("tool", "place", F.to_json("row").alias("row")).collect())
    assert rows("$.r") == [("banner", 0, '{"x":3}'), ("many", 0, '{"x":4}'), ("many", 1, '{"x":5}')]
    assert [x for x in rows("$") if x[0] == "plain"] == [("plain", 0, '{"x":1}'), ("plain", 1, '{"x":2}')]
    lines = frame(spark, [("t", '{"x":1}\n\nbad\n  {"x":"2"} ')], "tool string, text string")
    got = rp.tool_findings(rp.tool_rows(lines, lines=True), {"x": ["y", "x"], "severity": ["sev"]}, {"high": "critical"}).select("x", "severity").collect()
    assert sorted(map(tuple, got)) == [("1", "medium"), ("2", "medium")]


def test_graph_files(spark, tmp_path):
    from corvid.sources import records as rc

    nodes = [{"id": "a", "kind": "module", "name": "a", "file": "a.py", "attrs": {"x": [1]}}, {"id": "r", "kind": "requirement", "layer": "governance", "start_line": 3}, {"id": "a", "kind": "other"}, {"kind": "lost"}]
    edges = [{"source": "r", "target": "a", "type": "touches", "provenance": "EXTRACTED", "layer": "governance"}] * 2 + [{"source": "a", "target": None, "type": "calls"}]
    (tmp_path / "g.json").write_text(json.dumps({"version": 3, "nodes": nodes, "edges": edges}, indent=2))
    (tmp_path / "broken.json").write_text("{")
    n, e = rc.graph_json(spark, str(tmp_path))
    assert {(r["id"], r["kind"], r["layer"], r["start_line"], r["a"]) for r in n.withColumn("a", F.to_json("attrs")).collect()} == {("a", "module", "code", None, '{"x":[1]}'), ("r", "requirement", "governance", 3, None)}
    assert [tuple(r) for r in e.select("source", "target", "type", "layer").collect()] == [("r", "a", "touches", "governance")]
    rc.write_graph_json(n.drop("attrs"), e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 2


def test_review_marks(spark):
    from corvid.sources import records as rc

    text = "# review\n[y] f:abc123 title\n  [N] f:def456\n[?] f:111\n[ ] f:222\ny f:333\n[n] f:abc123 again\n"
    assert {tuple(r) for r in rc.review_marks(frame(spark, [(text,), (None,)], "text string")).collect()} == {("f:abc123", "false_positive"), ("f:def456", "false_positive")}


def test_module_imports_and_class_relations(spark):
    nodes = frame(spark, [("m:a", "module", "a.py", False), ("m:b", "module", "b.py", False), ("m:b2", "module", "b.py", False), ("c:A", "class", "a.py", False), ("c:B", "class", "b.py", False), ("c:T", "class", "t.py", True), ("c:A::run", "method", "a.py", False), ("f", "function", "a.py", None)], "id string, kind string, file string, test boolean")
    edges = frame(spark, [("m:a", "m:b", "imports"), ("m:a", "m:b2", "imports"), ("m:b", "m:b2", "imports"), ("m:a", "external:numpy.linalg", "imports"), ("c:A", "external:x.y", "imports"), ("c:A", "c:B", "inherits"), ("c:A", "external:abc.ABC", "inherits"), ("c:A", "c:T", "inherits"), ("c:T", "c:B", "inherits"), ("c:A::run", "c:B", "calls"), ("c:A::run", "c:A", "calls"), ("f", "c:B", "calls")], "source string, target string, type string")
    inner, outer = lo.module_imports(nodes, edges)
    assert [tuple(r) for r in inner.collect()] == [("a.py", "b.py")] and [tuple(r) for r in outer.collect()] == [("a.py", "numpy")]
    assert {tuple(r) for r in lo.class_relations(nodes, edges).collect()} == {("c:A", "c:B", "inherits"), ("c:A", "abc.ABC", "external"), ("c:A", "c:B", "creates")}


@pytest.mark.parametrize(("text", "found"), [("web/api", ("component", "web/api")), ("mod:x/", ("module", "mod:x")), ("STORE", ("component", "db/store")), ("client", ("module", "mod:client")), ("api", ("component", "web/api")), ("b", None), ("nothing", None)])
def test_members_by_name(spark, text, found):
    components = frame(spark, [("web/api", "api"), ("web/apis", "apis"), ("db/store", "store")], "id string, name string")
    modules = frame(spark, [("mod:x", "x"), ("mod:client", "Client"), ("mod:z/b", "z"), ("mod:y/b", "y")], "id string, name string")
    got = lo.find_member(components, modules, text).first()
    assert (tuple(got) if got else None) == found
