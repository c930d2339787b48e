"""Files of a repository and its records: inventory, registries, reports, history, git log, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import file_glob

# Paths of each role, in the order in which they are tried.
ROLE_PATHS = {
    "iac": r"\.tf$|\.tfvars$|template\.(ya?ml|json)$",
    "generated": r"(^|/)(cdk\.out[^/]*|dist|build|out|coverage|\.next)(/|$)|\.min\.(js|css)$|lock\.json$|\.lock$",
    "ci": r"(^|/)\.github/workflows/.*\.ya?ml$|(^|/)\.gitlab-ci\.ya?ml$|(^|/)Jenkinsfile$|(^|/)azure-pipelines\.ya?ml$",
    "test": r"(^|/)(tests?|spec|__tests__)(/|$)|(^|/)test_[^/]+$|_test\.[a-z]+$|\.(spec|test)\.[a-z]+$|_spec\.rb$|(^|/)src/test/|(^|/)src/(it|jmh|testFixtures|[A-Za-z0-9]+Test)/",
    "docs": r"(?i)(^|/)(docs?|\.ai)(/|$)|\.(md|rst|adoc)$",
}
# Languages of file endings and names; roles of languages.
LANGUAGES = {
    "py": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "go": "go",
    "rb": "ruby",
    "java": "java", "kt": "kotlin",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "cs": "csharp",
    "rs": "rust",
    "php": "php",
    "r": "r",
    "sh": "shell", "bash": "shell", "zsh": "shell",
    "ps1": "powershell",
    "tf": "terraform", "tfvars": "terraform", "hcl": "hcl",
    "yaml": "yaml", "yml": "yaml",
    "json": "json",
    "toml": "toml",
    "ini": "ini", "cfg": "ini",
    "md": "markdown", "markdown": "markdown", "rst": "rst",
    "sql": "sql",
    "html": "html", "css": "css", "scss": "css",
    "env": "dotenv",
}
CONFIG, TEXT = ["yaml", "json", "toml", "ini", "dotenv"], ["markdown", "rst"]
#: Larger files are data.
MOST_BYTES = 2_000_000


def language(path: Column) -> Column:
    """Language of a path by its name and ending; ``unknown`` for others."""
    name = F.substring_index(path, "/", -1)
    ending = F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(name.rlike(r"^(Dockerfile|Containerfile)(\.|$)"), "dockerfile").when(name.isin("Makefile", "Jenkinsfile"), F.lower(name)).otherwise(F.coalesce(F.try_element_at(known, ending), F.lit("unknown")))


def role(path: Column, lang: Column) -> Column:
    """[S4] Role of a file: the first of iac, generated, ci, test, docs by path, then config, docs, data, source by language."""
    out = F.when(lang.isin(CONFIG), "config").when(lang.isin(TEXT), "docs").when(lang == "unknown", "data").otherwise("source")
    for name, pattern in reversed(ROLE_PATHS.items()):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def inventory(spark: SparkSession, root: str, ignore: str = r"(^|/)(\.git|node_modules|__pycache__|\.venv|vendor)(/|$)") -> DataFrame:
    """[S2, S3, S6] files(path, size, binary, lines, language, role, text) below a folder; binary and large files have no text.

    A NUL in the first 4,096 bytes means binary unless the file begins with a byte-order mark; UTF-8, UTF-16
    and UTF-32 marks are honoured, and line ends become line feeds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.expr("substring_index(path, ':', -1)"), "^/+", "/")
    rel = F.substring(path, F.instr(path, base) + len(base), 10_000) if "://" not in root else F.substring_index("path", base, -1)
    head = F.hex(F.substring("content", 1, 4))
    wide = head.isin("FFFE0000", "0000FEFF")
    marked = wide | head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")
    nul = F.expr("position(X'00' IN substring(content, 1, 4096))") > 0
    kept = files.select(rel.alias("path"), F.col("length").alias("size"), "content", marked.alias("marked"), head.alias("head"), wide.alias("wide"), nul.alias("nul")).filter(~F.col("path").rlike(ignore))
    binary = (F.col("nul") & ~F.col("marked")) | (F.col("size") > MOST_BYTES)
    text = F.when(F.col("wide"), F.decode("content", "UTF-32")).when(F.col("head").startswith("FFFE") | F.col("head").startswith("FEFF"), F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    lines = F.regexp_replace(text, "\r\n?", "\n")
    rows = kept.select("path", "size", binary.alias("binary"), F.when(~binary, lines).alias("text")).withColumn("language", language(F.col("path")))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    count = F.when(F.col("binary") | (F.col("text") == ""), 0).otherwise(breaks + (~F.col("text").endswith("\n")).cast("int"))
    return rows.select("path", "size", "binary", count.alias("lines"), "language", F.when(F.col("binary"), "data").otherwise(role(F.col("path"), F.col("language"))).alias("role"), "text")


def lines_by(files: DataFrame, *keys: str) -> DataFrame:
    """[A9, A10] Files and lines of text files by language, role or repository; generated ones don't count."""
    return files.filter("NOT binary AND role <> 'generated'").groupBy(*keys).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def stacks(files: DataFrame, *keys: str) -> DataFrame:
    """[S5] (keys, stacks) of files(path, language, role): a stack stands when one of its signs does."""
    path, lang = F.col("path"), F.col("language")
    name = F.substring_index("path", "/", -1)
    tests = {
        "terraform": path.endswith(".tf"), "aws_cdk": (name == "cdk.json") | path.rlike(r"(^|/)cdk\.out/"), "cloudformation": path.endswith(".template.json"), "node": name == "package.json",
        "typescript": lang == "typescript", "python": name.isin("requirements.txt", "pyproject.toml", "setup.py", "Pipfile") | ((lang == "python") & (F.col("role") != "generated")),
        "javascript": lang == "javascript", "docker": lang == "dockerfile", "github_actions": path.rlike(r"(^|/)\.github/workflows/"), "gitlab_ci": name.isin(".gitlab-ci.yml", ".gitlab-ci.yaml"),
        "go": (name == "go.mod") | (lang == "go"), "java": name.isin("pom.xml", "build.gradle", "build.gradle.kts") | (lang == "java"), "ruby": name.isin("Gemfile", "Rakefile") | (lang == "ruby"),
        "cpp": (name == "CMakeLists.txt") | (lang == "cpp"), "r": lang == "r",
    }
    if "text" in files.columns:
        first = F.left("text", F.lit(2000))
        tests["kubernetes"] = F.coalesce((lang == "yaml") & (F.col("size") < 200_000) & first.rlike("(?m)^apiVersion:") & first.rlike("(?m)^kind:"), F.lit(False))
    per = files.groupBy(*keys).agg(*[F.bool_or(t).alias(s) for s, t in tests.items()])
    return per.select(*keys, F.array_sort(F.array_compact(F.array(*[F.when(F.col(s), s) for s in tests]))).alias("stacks"))


# Directories and file names of tests.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "e2e", "testing", "testdata"]
TEST_FILES = [
    "test_*.py", "*_test.py", "conftest.py",
    "*.test.[jt]s", "*.test.[jt]sx", "*.spec.[jt]s", "*.spec.[jt]sx", "*.test.mjs", "*.spec.mjs",
    "*Test.java", "*Tests.java", "*IT.java", "*ITCase.java", "*Spec.java",
    "*Test.kt", "*Tests.kt", "*Test.scala", "*Spec.scala",
    "*_test.go", "*_test.rs", "*Tests.cs", "*Test.cs", "*Test.php", "*_spec.rb", "*_test.rb",
    "*Tests.swift", "*Test.swift", "*_test.c", "*_test.cpp", "*_test.cc",
]


def is_test(path: Column, extra: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """[P13] Whether a path holds tests: never if excluded, always if added, else by its directories and name."""
    normal = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    fits = lambda globs: normal.rlike("|".join(map(file_glob, globs))) if globs else F.lit(False)
    parts = F.split(normal, "/")
    folder = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p).isin(TEST_DIRS))
    named = F.element_at(parts, -1).rlike("|".join(map(file_glob, TEST_FILES)))
    return (normal != "") & ~fits(exclude) & (fits(extra) | folder | named)


# --- records in JSON -----------------------------------------------------------------------------

REQUIREMENT = "id string, key string, number string, req string, title string, summary string, name string, description string, status string, state string, priority string, category string, type string, minimum_access_scope string, scope string, files string, paths string, affected_files string"
FAILURE = "id string, status string, title string, symptom string, how_detected string, requirement string, recurrence_of string, affected array<string>, regression_tests array<string>, prevention_rules array<string>, fix_commits array<string>"
SUITE = "id string, name string, command string, files array<string>, paths array<string>, covers array<string>, guards array<string>"
RULE = "id string, severity string, title string, description string, validation struct<type:string,when_changed:array<string>,ignore:array<string>,must_also_change:array<string>>"


def entries(spark: SparkSession, paths: str | list[str], names: list[str], schema: str) -> DataFrame:
    """Entries (file, seq, fields) of JSON documents that are a list, or hold one under the first of ``names``; files that are neither give none."""
    docs = spark.read.text(paths, wholetext=True).withColumn("file", F.input_file_name())
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    held = F.from_json("value", ", ".join(f"{n} array<struct<{_fields(schema)}>>" for n in names))
    one = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(*[held[n] for n in names]))
    return docs.select("file", F.posexplode(one).alias("seq", "e")).filter("e IS NOT NULL").select("file", "seq", "e.*")


def _fields(schema: str) -> str:
    """``a string, b int`` as the fields of a struct."""
    out, depth = "", 0
    for part in schema.split(", "):
        name, kind = part.split(" ", 1) if not depth else ("", part)
        out += (", " if out else "") + (f"{name}: {kind}" if name else kind)
    return out


def requirements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S7] id, title, status, priority, category, scope (array), file: aliases of fields are tried in order; of one id the first entry counts."""
    rows = entries(spark, paths, ["requirements", "items", "issues", "tasks"], REQUIREMENT)
    given = lambda *names: F.coalesce(*[F.nullif(n, F.lit("")) for n in names])
    raw = F.coalesce(*[F.when(~F.col(n).isin("", "[]"), F.col(n)) for n in ("minimum_access_scope", "scope", "files", "paths", "affected_files")])
    scope = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    named = rows.select(F.trim(given("id", "key", "number", "req")).alias("id"), F.coalesce(given("title", "summary", "name", "description"), F.lit("")).alias("title"), given("status", "state").alias("status"), "priority", given("category", "type").alias("category"), F.filter(scope, lambda x: x != "").alias("scope"), "file", "seq")
    rest = [c for c in named.columns if c != "id"]
    return named.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("file", "seq")).alias("r")).select("id", "r.*").drop("seq")


def failures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S8] Entries of a failure ledger."""
    return entries(spark, paths, ["failures"], FAILURE)


def suites(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S9] Entries of a test-suite registry."""
    return entries(spark, paths, ["suites"], SUITE)


def rules(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S10] Rules of rule packs."""
    return entries(spark, paths, ["rules"], RULE)


FINDING = "id: string, rule_id: string, title: string, description: string, dimension: string, severity: string, confidence: string, status: string, suppressed: boolean, provenance: string, repo_id: string, probe: string, evidence: string, tags: array<string>, cwe: array<string>, location: struct<path: string, start_line: int, end_line: int, logical: string>"


def reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S17] Findings of scanner reports: flat columns, the report's file and start time, position in the report.  Files that are no report give none."""
    docs = spark.read.text(paths, wholetext=True).withColumn("report", F.input_file_name())
    parsed = docs.select("report", F.from_json("value", f"started_at string, findings array<struct<{FINDING}>>").alias("d"))
    rows = parsed.select("report", F.col("d.started_at").alias("started_at"), F.posexplode("d.findings").alias("seq", "f")).select("report", "started_at", "seq", "f.*")
    place = {c: F.col(f"location.{c}").alias(c) for c in ("start_line", "end_line", "logical")}
    return rows.select("*", F.regexp_replace("location.path", r"\\", "/").alias("path"), *place.values()).drop("location")


def history(spark: SparkSession, path: str) -> DataFrame:
    """[S22] Rows of a history file, a JSON object a line; broken lines and those without a time are left out."""
    return _history(spark.read.text(path))


def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """[Z1] The same as a stream over the files of a folder."""
    return _history(spark.readStream.text(folder))


HISTORY = "time string, commit string, system string, profile string, mode string, grade string, score double, coverage double, counts map<string,int>, new_high_or_above int, gate_passed boolean, duration_s double, findings_total int"


def _history(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json(F.trim("value"), HISTORY).alias("r")).filter("r.time IS NOT NULL").select("r.*")


def append_history(rows: DataFrame, path: str) -> None:
    """[K4] Adds rows to a history folder, a JSON object a line."""
    rows.write.mode("append").json(path)


def trend(rows: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """[Z1] Runs, findings and lowest score of each window of ``time``; for tables and streams."""
    timed = rows.withColumn("ts", F.to_timestamp("time"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("runs"), F.sum("findings_total").alias("findings"), F.min("score").alias("lowest")).select(F.col("window.start").alias("start"), "runs", "findings", "lowest")


# --- git and change logs -------------------------------------------------------------------------


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """[S11] hash, parents, date, subject, body, files of a log written as records after \\x1e with fields between \\x1f."""
    return git_records(spark.read.option("lineSep", "\x1e").text(path))


def git_records(records: DataFrame) -> DataFrame:
    """[S11] The same of a column ``value`` with one record a row; records of fewer than six fields are left out."""
    p = F.split("value", "\x1f", -1)
    words = lambda c, sep: F.filter(F.transform(F.split(c, sep), F.trim), lambda x: x != "")
    rows = records.filter((F.size(p) >= 6) & (F.trim(F.regexp_replace(p[0], r"\s+", "")) != ""))
    clean = lambda k: F.regexp_replace(p[k], r"^\s+|\s+$", "")
    return rows.select(clean(0).alias("hash"), words(p[1], r"\s+").alias("parents"), clean(2).alias("date"), clean(3).alias("subject"), clean(4).alias("body"), words(p[5], "\n").alias("files"))


#: What git writes for a line that no commit holds yet.
UNCOMMITTED = "0" * 40


def git_blame(outputs: DataFrame) -> DataFrame:
    """[S12] (path, line, hash) of porcelain blame outputs(path, text): the commit of each line; lines that are not committed are left out."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^([0-9a-f]{40} [0-9]+ [0-9]+)(?: [0-9]+)?$"), F.lit(1))
    parts = F.split("head", " ")
    rows = outputs.select("path", F.explode(heads).alias("head")).select("path", parts[2].cast("int").alias("line"), parts[0].alias("hash"))
    return rows.filter(F.col("hash") != UNCOMMITTED).distinct()


def added_headings(diffs: DataFrame) -> DataFrame:
    """[S27] (hash, heading) of the Markdown headings that unified diffs(hash, text) add, in their order."""
    lines = diffs.select("hash", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "line"))
    some = lines.filter(F.col("line").rlike(r"^\+#{1,4}\s+\S") & ~F.startswith("line", F.lit("+++")))
    return some.select("hash", "n", F.regexp_extract("line", r"^\+#{1,4}\s+(.*?)\s*#*\s*$", 1).alias("heading"))


def _lines(docs: DataFrame) -> DataFrame:
    """(path, n, line, fence, open): the lines of docs(path, text), whether one is a fence, and whether it stands in fenced code."""
    rows = docs.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "line")).withColumn("n", F.col("n") + 1).withColumn("fence", F.ltrim("line").rlike("^(```|~~~)"))
    before = Window.partitionBy("path").orderBy("n")
    return rows.withColumn("open", (F.sum(F.col("fence").cast("int")).over(before) - F.col("fence").cast("int")) % 2 == 1)


def headings(docs: DataFrame) -> DataFrame:
    """[S13] (path, n, level, title) of the Markdown headings outside fenced code."""
    rows = _lines(docs).filter(~F.col("open") & ~F.col("fence") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    return rows.select("path", "n", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.regexp_extract("line", r"^#+\s+(.*?)\s*#*\s*$", 1).alias("title"))


DATE, VERSION = r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"v?([0-9]+\.[0-9]+(?:\.[0-9]+)?[0-9A-Za-z.+-]*)"


def changelog(docs: DataFrame) -> DataFrame:
    """[S13] (path, start, end, title, date, version) of the entries of change logs(path, text).

    Entries stand at the level of the headings that carry dates or versions (2, 1, 3, 4 are tried),
    else of those that say Unreleased, else at 2 or 3; one ends before the next heading of its level or above.
    """
    h = headings(docs)
    dated = F.col("title").rlike(DATE) | F.col("title").rlike(rf"(^|[\s\[]){VERSION}")
    open_ = dated | F.col("title").rlike(r"(?i)^\[?unreleased")
    marked = h.withColumn("tier", F.when(dated, 0).when(open_, 1).otherwise(2)).withColumn("order", F.array_position(F.array(*[F.lit(k) for k in (2, 1, 3, 4)]), F.col("level")))
    usable = marked.filter("order > 0 AND (tier < 2 OR level IN (2, 3))")
    level = usable.groupBy("path").agg(F.min_by("level", F.struct("tier", "order")).alias("entry"))
    total = docs.select("path", F.size(F.split("text", "\r\n|\r|\n")).alias("lines"))
    rows = h.join(level, "path").filter("level <= entry").withColumn("next", F.lead("n").over(Window.partitionBy("path").orderBy("n"))).filter("level = entry").join(total, "path")
    date = F.regexp_extract("title", DATE, 0)
    version = F.regexp_extract("title", rf"(?:^|[\s\[]){VERSION}", 1)
    starts = F.col("title").rlike(rf"^\[?{DATE}")
    return rows.select("path", F.col("n").alias("start"), (F.coalesce("next", F.col("lines") + 1) - 1).alias("end"), "title", F.nullif(date, F.lit("")).alias("date"), F.when(~starts, F.nullif(version, F.lit(""))).alias("version"))


def bullets(docs: DataFrame) -> DataFrame:
    """[S14] (path, start, end, text) of the top-level bullets of texts; what follows belongs to the bullet above it until a heading."""
    rows = _lines(docs)
    code = F.col("open") | F.col("fence")
    head = ~code & F.col("line").rlike(r"^#{1,6}\s+\S")
    start = ~code & F.col("line").rlike(r"^[-*+]\s+\S")
    w = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumns({"head": head, "start": start}).withColumn("block", F.sum((F.col("head") | F.col("start")).cast("int")).over(w))
    first = rows.filter("start").select("path", "block", F.col("n").alias("begin"))
    kept = rows.filter("NOT head").join(first, ["path", "block"])
    return kept.groupBy("path", F.col("begin").alias("start")).agg(F.max("n").alias("end"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).select("path", "start", "end", F.array_join(F.col("l.line"), "\n").alias("text"))


# --- graphs --------------------------------------------------------------------------------------

NODE = "id string, kind string, name string, qualified_name string, file string, start_line int, end_line int, language string, summary string, layer string, attrs variant"
LINK = "source string, target string, type string, provenance string, resolver string, detail string, layer string"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """[K1, S1] Nodes and edges of graph files, each a JSON document with ``nodes`` and ``edges``; the layer is ``code`` where none is written.

    Of nodes with one id the first in a file counts, of equal edges one stays.
    """
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    each = lambda name, schema: docs.select(F.posexplode(F.try_variant_get("d", f"$.{name}", "array<variant>")).alias("pos", "v")).select("pos", *[F.try_variant_get("v", f"$.{c}", t).alias(c) for c, t in (x.split() for x in schema.split(", "))])
    layered = lambda df: df.withColumn("layer", F.coalesce("layer", F.lit("code")))
    nodes = layered(each("nodes", NODE).filter("id IS NOT NULL"))
    rest = [c for c in nodes.columns if c not in ("pos", "id")]
    once = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("id", "r.*")
    return once, layered(each("edges", LINK).filter("source IS NOT NULL AND target IS NOT NULL")).drop("pos").distinct()


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """[K1] A graph as two folders of JSON lines, ``nodes`` and ``edges``, that any number of tasks write."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def review_marks(texts: DataFrame) -> DataFrame:
    """[S30] (id, verdict) of review files(text): lines like ``[y] f:id``; y is a true positive, n a false one, others are skipped.  Of several marks of an id in a file the last counts."""
    lines = texts.select(F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pattern = r"^\s*\[([ yYnNsS?])\]\s*(f:[0-9a-f]{6,})\b"
    marks = lines.select("n", F.lower(F.regexp_extract("line", pattern, 1)).alias("mark"), F.regexp_extract("line", pattern, 2).alias("id")).filter("mark IN ('y', 'n')")
    return marks.groupBy("id").agg(F.max_by(F.when(F.col("mark") == "y", "true_positive").otherwise("false_positive"), "n").alias("verdict"))
