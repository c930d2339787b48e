
from __future__ import annotations

import io
import tokenize
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvid.functions.scalars import line_of

# Comments that silence an analyser; group 1 names the rules.
SUPPRESSIONS = [
    ("ruff/flake8", r"#\s*noqa(?::\s*([A-Z]+[0-9]+(?:\s*,\s*[A-Z]+[0-9]+)*))?"),
    ("bandit", r"#\s*nosec(?:\s+(B[0-9]+(?:\s*,\s*B[0-9]+)*))?"),
    ("mypy", r"#\s*type:\s*ignore(?:\[([a-z-]+(?:\s*,\s*[a-z-]+)*)\])?"),
    ("pylint", r"#\s*pylint:\s*disable=?\s*([\w-]+(?:\s*,\s*[\w-]+)*)?"),
    ("eslint", r"//\s*eslint-disable(?:-next-line|-line)?(?:\s+([\w@/-]+(?:\s*,\s*[\w@/-]+)*))?"),
    ("typescript", r"//\s*@ts-(?:ignore|nocheck|expect-error)()"),
    ("checkov", r"checkov:skip=([\w]+)?"),
    ("tfsec", r"tfsec:ignore:([\w-]+)?"),
    ("trivy", r"trivy:ignore:([\w-]+)?"),
    ("semgrep", r"nosemgrep(?::\s*([\w.-]+))?"),
    ("golangci", r"//\s*nolint(?::\s*([\w,-]+))?"),
    ("java", r'@SuppressWarnings\(\s*[{"]?([^)]*)'),
    ("rust", r"#!?\[allow\(([^)]*)\)\]"),
    ("csharp", r"#pragma\s+warning\s+disable\s*([\w,\s]*)"),
    ("sonar", r"//\s*NOSONAR(.*)$"),
]
# A reason on the same line; paths where suppressions are expected; those that count in declared infrastructure only.
JUSTIFIED = r"(?:#|//)\s*\S.{12,}"
EXPECTED = r"(^|/)(vendor|third_party|node_modules|\.venv|migrations|generated|proto|pb)(/|$)|\.(pb|generated|g)\.[a-z]+$"
IAC_ONLY = ["checkov", "tfsec", "trivy"]
# Files that list what an analyser skips, shared configurations, and their settings that do.
EXCLUDE_FILES = {
    ".semgrepignore": "semgrep",
    ".eslintignore": "eslint",
    ".gitleaksignore": "gitleaks",
    ".trivyignore": "trivy",
    ".checkov.yaml": "checkov",
    ".checkov.yml": "checkov",
    ".bandit": "bandit",
    ".golangci.yml": "golangci-lint",
    ".golangci.yaml": "golangci-lint",
}
SHARED_CONFIGS = ["pyproject.toml", "setup.cfg", "tox.ini", ".flake8", "eslint.config.js", ".eslintrc", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml"]
EXCLUDE_KEYS = r"(?imd)^\s*(exclude|excludes|exclude_paths|exclude-dirs|extend-exclude|skip-path|skip_path|ignorePatterns|per-file-ignores|skip-check|skip_check)\b"
# Tests that are skipped whatever happens, where tests begin, what lets one fail, and what is none.
SKIPPED = r"@pytest\.mark\.(?:skip|xfail)\b(?!\s*\(\s*condition)|@unittest\.skip\b|\bit\.skip\s*\(|\bdescribe\.skip\s*\(|\bxit\s*\(|\bxdescribe\s*\(|\bt\.Skip\s*\(\s*\)|@(?:Disabled|Ignore)\b"
TEST_BEGINS = (
    r"(?md)^\s*(?:async\s+)?def\s+(test_[A-Za-z0-9_]*)\s*\([^)]*\)\s*:"
    r"|^\s*(?:it|test)\s*\(\s*[\"'`]([^\"'`]{1,80})[\"'`]\s*,\s*(?:async\s*)?\(?\s*\)?\s*=>\s*\{"
    r"|^\s*func\s+(Test[A-Za-z0-9_]*)\s*\("
)
CAN_FAIL = (
    r"\bassert\b|\bexpect\s*\(|\.should\b|\bassert[A-Z]\w*\s*\(|\bt\.(?:Error|Fatal|Fail)\w*\s*\(|\brequire\.\w+\s*\(|\bassert\.\w+\s*\(|\bpytest\.raises\b|\bwith\s+self\.assertRaises\b|\bthrows?\b"
    r"|\.EXPECT\s*\(|\.AssertExpectations\s*\(|\.assert_called\w*\s*\(|\.Verify\s*\(|verify\s*\(|\.toHaveBeenCalled"
    r"|\w+\(\s*t\s*[,)]|\w+\(\s*self\s*[,)]|\w+\(\s*tt?\s*,|\b\w*(?:assert|check|verify|validate|expect)\w*\s*\(|toMatchSnapshot|golden|\bcmp\.Diff\s*\("
    r"|\.(?:resource_count_is|resourceCountIs|has_resource_properties|hasResourceProperties|has_resource\b|hasResource\b|find_resources|findResources|has_output|hasOutput|has_condition|hasCondition|"
    r"has_mapping|hasMapping|has_parameter|hasParameter|template_matches|templateMatches)\s*\("
)
NO_TEST = r"^(TestMain|TestAccPreCheck|TestHelperProcess)$"
FINDING = ["rule", "repo_id", "path", "line", "evidence", "severity", "confidence"]


def located(text: Column, pattern: str, groups: int = 1) -> Column:
    """All matches of a pattern as structs of ``at`` (offset from 0), ``found`` and the first group that took part; what stands between two matches tells where the next one is."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    named = all_of(1)
    for g in range(2, groups + 1):
        named = F.zip_with(named, all_of(g), lambda a, b: F.when(a != "", a).otherwise(b))
    each = F.zip_with(F.arrays_zip(all_of(0).alias("found"), named.alias("named")), F.slice(F.split(text, pattern, -1), 1, 1_000_000_000), lambda m, before: F.struct(m["found"].alias("found"), m["named"].alias("named"), F.length(before).alias("gap")))
    # The text after the last match has none of its own.
    each = F.filter(each, lambda m: m["found"].isNotNull())
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,found:string,named:string>>").alias("out"))
    step = lambda s, m: F.struct((s["end"] + m["gap"] + F.length(m["found"])).alias("end"), F.concat(s["out"], F.array(F.struct((s["end"] + m["gap"]).alias("at"), m["found"].alias("found"), m["named"].alias("named")))).alias("out"))
    return F.aggregate(each, start, step, lambda s: s["out"])


@F.pandas_udf(StringType())
def python_comments(text: pd.Series) -> pd.Series:
    """Python source with all but its comments blanked: what stands in a string silences nothing.  Text that is no Python stays."""

    def one(source: str) -> str:
        lines = source.split("\n")
        out = [" " * len(x) for x in lines]
        try:
            for token in tokenize.generate_tokens(io.StringIO(source).readline):
                if token.type == tokenize.COMMENT:
                    (row, a), (_, b) = token.start, token.end
                    out[row - 1] = out[row - 1][:a] + lines[row - 1][a:b] + out[row - 1][b:]
        except (tokenize.TokenError, SyntaxError, ValueError):
            return source
        return "\n".join(out)

    return text.map(one)


def _finding(rows: DataFrame, rule: str, line: Column, evidence: Column, severity: str, confidence: str = "high") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "repo_id", "path", line.cast("int").alias("line"), evidence.alias("evidence"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))


def suppressions(files: DataFrame) -> DataFrame:
    """[R14] (repo_id, path, tool, line, blanket, justified, text) of every comment that silences an analyser in files(repo_id, path, role, language, text)."""
    some = files.filter("role NOT IN ('generated', 'docs') AND coalesce(text, '') <> ''").filter(~F.col("path").rlike(EXPECTED)).select("repo_id", "path", "role", "language", "text")
    # Only sources that hold one at all are read by the tokenizer.
    some = some.filter(F.col("text").rlike("(?m)" + "|".join(p for _, p in SUPPRESSIONS)))
    python = some.filter("language = 'python'").withColumn("text", python_comments("text"))
    some = python.unionByName(some.filter("coalesce(language, '') <> 'python'"))
    hits = F.flatten(F.array(*[_silenced(t, p) for t, p in SUPPRESSIONS]))
    each = some.select("repo_id", "path", "text", F.explode(hits).alias("h"))
    before = F.substring_index(F.substring("text", F.lit(1), F.col("h.at")), "\n", -1)
    line = F.concat(before, F.substring_index(F.substring("text", F.col("h.at") + 1, F.length("text")), "\n", 1))
    after = F.substring(line, F.length(before) + F.length("h.found") + 1, F.length(line))
    return each.select("repo_id", "path", "h.tool", line_of(F.col("text"), F.col("h.at")).alias("line"), (F.trim(F.regexp_replace("h.named", r"\s+", " ")) == "").alias("blanket"), (after.rlike(JUSTIFIED) | before.rlike(JUSTIFIED)).alias("justified"), F.substring(F.regexp_replace(line, r"^\s+|\s+$", ""), 1, 110).alias("text"))


def _silenced(tool: str, pattern: str) -> Column:
    """The matches of one tool's comments, with its name; those for declared infrastructure don't count in tests."""
    found = located(F.col("text"), f"(?md){pattern}")
    if tool in IAC_ONLY:
        found = F.filter(found, lambda m: F.col("role") != "test")
    return F.transform(found, lambda m: F.struct(F.lit(tool).alias("tool"), m["at"].alias("at"), m["found"].alias("found"), m["named"].alias("named")))


def exclusions(files: DataFrame) -> DataFrame:
    """[R14] Findings on files that list what an analyser skips, and on shared configurations that narrow what is looked at."""
    base = F.substring_index("path", "/", -1)
    rows = files.filter("text IS NOT NULL").withColumn("base", base)
    tools = F.map_from_arrays(F.array(*map(F.lit, EXCLUDE_FILES)), F.array(*map(F.lit, EXCLUDE_FILES.values())))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    listed = rows.filter(F.col("base").isin(*EXCLUDE_FILES)).withColumn("lines", lines).filter(F.size("lines") > 0)
    keys = F.regexp_extract_all("text", F.lit(EXCLUDE_KEYS), F.lit(1))
    shared = rows.filter(F.col("base").isin(SHARED_CONFIGS)).withColumn("keys", keys).filter(F.size("keys") > 0)
    first = line_of(F.col("text"), F.regexp_instr("text", F.lit(EXCLUDE_KEYS)) - 1)
    return _finding(listed, "assurance.analysis-excluded", F.lit(1), F.concat(F.element_at(tools, F.col("base")), F.lit(":"), F.array_join(F.slice("lines", 1, 6), "; ")), "low").unionByName(
        _finding(shared, "assurance.analysis-excluded", first, F.concat("base", F.lit(":"), F.array_join(F.slice(F.array_sort(F.array_distinct("keys")), 1, 6), ",")), "info", "medium")
    )


def weak_tests(files: DataFrame) -> DataFrame:
    """[R14] Findings on tests that are always skipped, and on tests whose body, up to the next test, holds nothing that can fail."""
    tests = files.filter("role = 'test' AND coalesce(text, '') <> ''").select("repo_id", "path", "text")
    skip = tests.filter(F.col("text").rlike(SKIPPED)).select("repo_id", "path", "text", F.explode(located(F.col("text"), f"(?d)({SKIPPED})")).alias("h"))
    before = F.ltrim(F.substring_index(F.substring("text", F.lit(1), F.col("h.at")), "\n", -1))
    comment = before.rlike(r"^(\*|/\*|//|#)") | F.contains(before, F.lit("{@code")) | F.contains(before, F.lit("{@link"))
    skipped = _finding(skip.filter(~comment), "assurance.permanently-skipped-test", line_of(F.col("text"), F.col("h.at")), F.concat(F.lit("skipped:"), F.substring("h.found", 1, 60)), "low")
    defs = tests.filter(F.col("text").rlike(TEST_BEGINS)).select("repo_id", "path", "text", located(F.col("text"), TEST_BEGINS, 3).alias("d"))
    ends = F.concat(F.slice(F.transform("d", lambda x: x["at"]), F.lit(2), F.size("d")), F.array(F.length("text")))
    body = defs.select("repo_id", "path", "text", F.explode(F.arrays_zip("d", ends.alias("end"))).alias("b")).withColumn("body", F.substring("text", F.col("b.d.at") + 1, F.col("b.end") - F.col("b.d.at")))
    idle = body.filter(F.regexp_replace("body", r"^\s+|\s+$", "").contains("\n")).filter(~F.col("b.d.named").rlike(NO_TEST) & ~F.col("body").rlike(CAN_FAIL) & ~F.col("body").rlike(SKIPPED))
    return skipped.unionByName(_finding(idle, "assurance.test-asserts-nothing", line_of(F.col("text"), F.col("b.d.at")), F.concat(F.lit("no-assertion:"), "b.d.named"), "low", "medium"))


def _first(rows: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("path", "line", "evidence"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def assurance_findings(files: DataFrame, sites: int | None = 200, tests: int | None = 100) -> DataFrame:
    """[R14] All findings: blanket suppressions (of a repository the first ``sites``; None: all), a census of each repository's suppressions, exclusions, skipped tests, and tests without an assertion (the first ``tests``)."""
    found = suppressions(files)
    blanket = _first(_finding(found.filter("blanket"), "assurance.blanket-suppression", F.col("line"), F.concat("tool", F.lit(":"), "text"), "low"), sites)
    per = found.groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if("blanket").alias("blanket"), F.count_if(~F.col("justified")).alias("bare"))
    census = _finding(per.withColumn("path", F.lit("")), "assurance.suppression-census", F.lit(None), F.concat(F.lit("suppressions:"), "n", F.lit(" blanket:"), "blanket", F.lit(" unexplained:"), "bare"), "info")
    weak = weak_tests(files)
    idle = F.col("rule") == "assurance.test-asserts-nothing"
    return reduce(DataFrame.unionByName, [blanket, census, exclusions(files), weak.filter(~idle), _first(weak.filter(idle), tests)])
