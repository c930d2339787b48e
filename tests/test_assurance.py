"""Suppressions, exclusions and idle tests on small rows."""

from corvid.operators import assurance as asr

SCHEMA = "repo_id string, path string, role string, language string, text string"


def findings(spark, *files, **limits):
    return {(r["rule"].partition(".")[2], r["path"], r["line"], r["evidence"]) for r in asr.assurance_findings(spark.createDataFrame([("r", *f) for f in files], SCHEMA), **limits).collect()}


def test_matches_and_where_they_are(spark):
    df = spark.createDataFrame([("xaby abz", ), ("none",), ("ab",), ("",), ("éabab",)], "t string")
    from pyspark.sql import functions as F

    got = [[(m["at"], m["found"], m["named"]) for m in r[0]] for r in df.select(asr.located(F.col("t"), "(a)b")).collect()]
    assert got == [[(1, "ab", "a"), (5, "ab", "a")], [], [(0, "ab", "a")], [], [(1, "ab", "a"), (3, "ab", "a")]]


def test_suppressions(spark):
    source = 'x = 1  # noqa\ny = "# noqa"\nz = 2  # noqa: E501 because the line is a long url\n"""\n# type: ignore\n"""\nw = 3  # nosec # type: ignore[attr]\n'
    broken = "def (:\n  s = '# noqa'\n"
    script = "// eslint-disable\nfoo() // eslint-disable-line no-console\n// @ts-ignore\n"
    files = [("a.py", "source", "python", source), ("b.py", "source", "python", broken), ("c.js", "source", "javascript", script), ("docs/x.md", "docs", "markdown", "# noqa"), ("vendor/v.py", "source", "python", "x # noqa"), ("t.tf", "test", "terraform", "checkov:skip=CKV_1 # noqa"), ("m.tf", "iac", "terraform", "# tfsec:ignore:\n# checkov:skip=CKV_1"), ("n.py", "source", "python", None)]
    got = findings(spark, *files)
    assert {g for g in got if g[0] == "blanket-suppression"} == {
        ("blanket-suppression", "a.py", 1, "ruff/flake8:# noqa"), ("blanket-suppression", "a.py", 7, "bandit:# nosec # type: ignore[attr]"), ("blanket-suppression", "b.py", 2, "ruff/flake8:s = '# noqa'"),
        ("blanket-suppression", "c.js", 3, "typescript:// @ts-ignore"), ("blanket-suppression", "t.tf", 1, "ruff/flake8:checkov:skip=CKV_1 # noqa"), ("blanket-suppression", "m.tf", 1, "tfsec:# tfsec:ignore:"),
    }
    census = [g[3] for g in got if g[0] == "suppression-census"]
    assert census == ["suppressions:11 blanket:6 unexplained:10"]
    assert len([g for g in findings(spark, *files, sites=2) if g[0] == "blanket-suppression"]) == 2


def test_exclusions(spark):
    files = [(".semgrepignore", "data", "unknown", "# c\n\n src/\nlib/\n"), ("x/.bandit", "data", "unknown", "# only\n"), ("pyproject.toml", "config", "toml", "[tool.ruff]\n  exclude = []\n[tool.ruff.lint.per-file-ignores]\nper-file-ignores = 1\nexclude = 2\n"), ("setup.cfg", "config", "ini", "[x]\nexcluded = 1\n")]
    assert findings(spark, *files) == {("analysis-excluded", ".semgrepignore", 1, "semgrep:src/; lib/"), ("analysis-excluded", "pyproject.toml", 2, "pyproject.toml:exclude,per-file-ignores")}


def test_tests_that_cannot_fail(spark):
    python = "import x\n\n\ndef test_one(\n    a,\n):\n    run(a)\n\ndef test_two():\n    assert 1\n\n@pytest.mark.skip\ndef test_three():\n    pass\n    pass\ndef test_four(): pass\nasync def test_five():\n    helper_checks(1)\n\nclass T:\n    def test_six(self):\n        y = 1\n"
    script = "it('works', () => {\n  run();\n});\ntest(`sees`, async () => {\n  expect(1);\n});\nxit('later');\n// it.skip(x)\n"
    go = "func TestMain(m *M) {\n  run()\n}\nfunc TestIt(t *T) {\n  run(1)\n}\nfunc TestHelp(t *T) {\n  helper(t)\n}\n"
    files = [("t.py", "test", "python", python), ("t.ts", "test", "typescript", script), ("t.go", "test", "go", go), ("s.py", "source", "python", python)]
    got = {(a, p, n, e) for a, p, n, e in findings(spark, *files) if a != "suppression-census"}
    assert got == {
        ("test-asserts-nothing", "t.py", 2, "no-assertion:test_one"), ("test-asserts-nothing", "t.py", 13, "no-assertion:test_three"), ("permanently-skipped-test", "t.py", 12, "skipped:@pytest.mark.skip"),
        ("test-asserts-nothing", "t.ts", 1, "no-assertion:works"), ("permanently-skipped-test", "t.ts", 7, "skipped:xit("), ("test-asserts-nothing", "t.go", 4, "no-assertion:TestIt"),
    }
