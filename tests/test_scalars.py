import re

from pyspark.sql import functions as F

from corvid.functions import scalars as s
from corvid.operators.findings import suppress
from corvid.operators.stats import record_verdicts


def test_globs_differ():
    assert re.search(s.file_glob("a/*.py"), "a/b/c.py")
    assert not re.search(s.gate_glob("a/*.py"), "a/b/c.py")
    assert re.search(s.gate_glob("**/x.py"), "x.py") and re.search(s.gate_glob("a/**"), "a/b/c")


def test_fingerprint_ignores_case_and_space_not_digits(spark):
    df = spark.createDataFrame([("r", "a", "p", "", "X  1"), ("r", "a", "p", "", " x 1 "), ("r", "a", "p", "", "x 2"), ("r", None, "p", None, None)], "a string, b string, c string, d string, e string")
    ids = [r[0] for r in df.select(s.fingerprint(*(F.col(c) for c in "abcde"))).collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 14 for i in ids)


def test_wilson_entropy_mask(spark):
    r = spark.range(1).select(s.wilson_lower(F.lit(10), F.lit(10)), s.wilson_lower(F.lit(0), F.lit(0)), s.entropy(F.lit("abab")), s.entropy(F.lit("")), s.masked(F.lit("abcdefghijkl")), s.masked(F.lit("abc"))).first()
    assert abs(r[0] - 0.722) < 1e-3 and r[1] == 0 and r[2] == 1 and r[3] == 0 and r[4] == "abcd****ijkl" and r[5] == "***"


def test_thresholds(spark):
    df = spark.createDataFrame([("critical",), ("low",), ("odd",), (None,)], "v string")
    assert [r[0] for r in df.select(s.at_least(F.col("v"), "high")).collect()] == [True, False, False, False]
    assert not any(r[0] for r in df.select(s.at_least(F.col("v"), "unknown")).collect())


def test_suppression_dates(spark):
    df = spark.createDataFrame([("i", "r.1", "a/b.py")], "id string, rule_id string, path string")
    assert suppress(df, [{"rule": "r.*", "expires": "bad"}, {"path": "a/*"}], "2024-01-01").first()["suppressed_by"] == 1


def test_one_verdict_for_each_id(spark):
    known = spark.createDataFrame([("a", True, "x")], "id string, truth boolean, reviewer string")
    new = spark.createDataFrame([("a", False, "y", 1), ("b", True, "y", 2), ("b", False, "y", 3), ("c", True, " ", 4)], "id string, truth boolean, reviewer string, seq int")
    assert sorted((r["id"], r["truth"]) for r in record_verdicts(known, new).collect()) == [("a", True), ("b", True)]


def test_globs_with_sets_of_characters():
    import fnmatch
    import re

    from corvid.functions.scalars import file_glob

    texts = ["x.test.js", "x.test.cs", "secrets.aws", "secrets.b", "abc", "axc", "a[b", "]x", "a^", "ab", "xb1", "zq", "a[]b", "xk", "]k", "a/b/c.py", "a&b", "a\\b"]
    for pattern in ["*.test.[jt]s", "secrets.[ag]*", "a[!b]c", "a[b", "[]]x", "a[^b]", "x[a-c]?", "[z-a]q", "a[]b", "[!]]k", "a*.py", "a[&]b", "a[\\]b"]:
        assert [bool(re.search(file_glob(pattern), t)) for t in texts] == [fnmatch.fnmatchcase(t, pattern) for t in texts], pattern


def test_files_of_every_language_and_role(spark):
    from pyspark.sql import functions as F

    from corvid.sources import records as rc

    want = {
        "a/x.tsx": ("typescript", "source"), "x.jsx": ("javascript", "source"), "x.h": ("c", "source"), "x.cs": ("csharp", "source"), "x.php": ("php", "source"), "x.kt": ("kotlin", "source"), "x.html": ("html", "source"), "x.scss": ("css", "source"),
        "x.cfg": ("ini", "config"), "x.bash": ("shell", "source"), "x.ps1": ("powershell", "source"), "x.hcl": ("hcl", "source"), "x.tfvars": ("terraform", "iac"), "x.pyi": ("python", "source"), "x.R": ("r", "source"), "x.unknown": ("unknown", "data"), "Makefile": ("makefile", "source"),
    }
    df = spark.createDataFrame([(p,) for p in want], "path string").withColumn("language", rc.language(F.col("path")))
    assert {r["path"]: (r["language"], r["role"]) for r in df.withColumn("role", rc.role(F.col("path"), F.col("language"))).collect()} == want
    tests = {"a/e2e/x.py": True, "a/testdata/x.json": True, "x.test.tsx": True, "x.spec.js": True, "x.test.css": False, "FooIT.java": True, "a/contest.py": False, "conftest.py": True}
    assert {r["path"]: r["t"] for r in spark.createDataFrame([(p,) for p in tests], "path string").select("path", rc.is_test(F.col("path")).alias("t")).collect()} == tests


def test_weights_and_unknown_words(spark):
    from pyspark.sql import functions as F

    from corvid.functions.scalars import weight
    from corvid.operators import findings as fi

    rows = [("critical", "medium"), ("odd", "high"), ("high", "odd"), ("info", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string, c string").select(weight(F.col("s"), F.col("c"))).collect()] == [24.0, 1.0, 16.0, 0.0]
    card = spark.createDataFrame([("security", 1, 1, 100.0), ("compliance", 1, 1, 0.0)], "dimension string, applicable int, run int, score double")
    assert fi.overall(card).first()["overall"] == 75.0
    found = spark.createDataFrame([("b", None), ("a", "rule"), ("b", None), ("c", None)], "id string, suppressed_by string")
    assert [r["id"] for r in fi.baseline_ids(found).collect()] == ["b", "c"]


def test_what_is_binary(spark, tmp_path):
    from corvid.sources import records as rc

    wide = "key = 'ä'\n"
    for name, raw in {"late.py": b"x" * 4096 + b"\0", "early.py": b"x\0", "w16.py": b"\xff\xfe" + wide.encode("utf-16-le"), "w32.py": b"\xff\xfe\0\0" + wide.encode("utf-32-le"), "b32.py": b"\0\0\xfe\xff" + wide.encode("utf-32-be"), "u8.py": b"\xef\xbb\xbf" + wide.encode()}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"]: (r["binary"], r["text"]) for r in rc.inventory(spark, str(tmp_path)).collect()}
    assert got["early.py"] == (True, None) and got["late.py"][0] is False
    assert {got[k] for k in ("w16.py", "w32.py", "b32.py", "u8.py")} == {(False, wide)}
