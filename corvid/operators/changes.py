"""What a change set means: rules over changed paths, requirements behind findings, suites to run, reports merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import SEVERITIES, any_glob, directories, line_of

def _none() -> Column:
    return F.array().cast("array<string>")


def co_changed(changed: DataFrame, when: list[str], must: list[str], ignore: list[str] | None = None) -> DataFrame:
    """[I2] One row (triggers, met, violated): changed paths that fit ``when`` and not ``ignore`` ask for one that fits ``must``."""
    path = F.col("path")
    found = changed.select("path").distinct().agg(F.count_if(any_glob(path, when) & ~any_glob(path, ignore or [])).alias("triggers"), F.coalesce(F.bool_or(any_glob(path, must)), F.lit(False)).alias("met"))
    return found.withColumn("violated", (F.col("triggers") > 0) & ~F.col("met") & F.lit(bool(must)))


def forbidden_content(files: DataFrame, patterns: list[tuple[str, str]], when: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """[I3] (path, line, message) of the first pattern (regex, message) that each file(path, text) holds; one hit a file."""
    some = files.filter(any_glob(F.col("path"), when or ["**"]) & ~any_glob(F.col("path"), ignore or []))
    at, message = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, said in reversed(patterns):
        hit = F.col("text").rlike(pattern)
        at, message = F.when(hit, F.regexp_instr("text", F.lit(pattern))).otherwise(at), F.when(hit, said).otherwise(message)
    return some.select("path", "text", at.alias("at"), message.alias("message")).filter("message IS NOT NULL").select("path", line_of(F.col("text"), F.col("at") - 1).alias("line"), "message")


def _trimmed(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^\./", ""), "/+$", "")


def impacted_suites(suites: DataFrame, impacted: DataFrame) -> DataFrame:
    """[I5] Suites(suite, entry) with an entry that is an impacted path, above one, below one, or a glob that fits one.

    Entries and paths meet by equality on their directories, so no entry is held against every path;
    a glob meets the paths below its fixed directories.
    """
    entries = suites.select("suite", _trimmed(F.col("entry")).alias("entry")).filter("entry <> ''").distinct()
    paths = impacted.select(F.regexp_replace(F.regexp_replace(F.trim("path"), r"\\", "/"), "/+$", "").alias("path")).filter("path <> ''").distinct()
    plain, globs = entries.filter(~F.col("entry").rlike(r"[*?\[]")), entries.filter(F.col("entry").rlike(r"[*?\[]"))
    over = paths.select(F.explode(F.concat(directories(F.col("path")), F.array("path"))).alias("entry")).distinct()
    below = plain.select("suite", F.explode(directories(F.col("entry"))).alias("path"))
    fixed = F.regexp_extract("entry", r"^([^*?\[]*)/[^/]*[*?\[]", 1)
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace("entry", r"([.+^$(){}|\\])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    # Globs that begin with a wildcard meet all paths, which are dealt out so that no task has them all.
    salts = F.when(F.col("folder") == "", F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(0)))
    wide = globs.select("suite", fixed.alias("folder"), F.concat(F.lit("(?s)^"), regex, F.lit("$")).alias("regex")).withColumn("salt", F.explode(salts))
    places = paths.select("path", F.explode(F.concat(F.array(F.lit("")), directories(F.col("path")))).alias("folder")).withColumn("salt", F.when(F.col("folder") == "", F.pmod(F.xxhash64("path"), F.lit(32)).cast("int")).otherwise(0))
    hits = plain.join(over, "entry", "left_semi").select("suite").unionByName(below.join(paths, "path", "left_semi").select("suite"))
    return hits.unionByName(wide.join(places, ["folder", "salt"]).filter(F.expr("path RLIKE regex")).select("suite")).distinct()


def cited_ids(texts: DataFrame, key: str, aliases: DataFrame, prefix: str = "REQ") -> DataFrame:
    """[I7, J20] (key, id) distinct: ids that ``texts(key, message)`` cite, old ones as their new ones; other projects' ids are dropped."""
    found = texts.select(key, F.explode(F.regexp_extract_all("message", F.lit(r"\b([A-Z][A-Z0-9]*-[0-9]+)\b"), 1)).alias("old"))
    named = found.join(aliases.select("old", "new").dropDuplicates(["old"]), "old", "left")
    return named.filter(F.col("new").isNotNull() | F.startswith("old", F.lit(f"{prefix}-"))).select(key, F.coalesce("new", "old").alias("id")).distinct()


def unknown_ids(cited: DataFrame, known: DataFrame) -> DataFrame:
    """[J20] Cited ids that no registry holds, sorted."""
    return cited.select("id").distinct().join(known.select("id"), "id", "left_anti").orderBy("id")


def id_lookup(registries: DataFrame) -> DataFrame:
    """[J21] name -> node of registries(node, bare, aliases array, root boolean, seq): the root's ids first, then ids and aliases of the others by sequence."""
    own = registries.select(F.col("bare").alias("name"), "node", F.when(F.col("root"), 0).otherwise(1).alias("tier"), "seq")
    old = registries.filter("NOT root").select(F.explode("aliases").alias("name"), "node", F.lit(1).alias("tier"), "seq")
    # Of two root entries with one id the later one counts, of others the first.
    place = F.struct("tier", F.when(F.col("tier") == 0, -F.col("seq")).otherwise(F.col("seq")))
    return own.unionByName(old).groupBy("name").agg(F.min_by("node", place).alias("node"))


def attribute_requirements(findings: DataFrame, commits: DataFrame, commit_files: DataFrame, changed: DataFrame, aliases: DataFrame, prefix: str = "REQ") -> DataFrame:
    """[I7] Findings with ``tags``: the requirements that the commits cite which touched the path, else all that the range cites.

    commits(hash, message), commit_files(hash, path), changed(path).  Findings outside the change get no tag.
    """
    cites = cited_ids(commits, "hash", aliases, prefix)
    by_path = commit_files.select("hash", F.regexp_replace(F.trim("path"), r"\\", "/").alias("path")).join(cites, "hash").groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("own"))
    every = cites.agg(F.array_sort(F.collect_set("id")).alias("every"))  # as many as there are requirements
    rows = findings.join(changed.select("path").distinct().withColumn("in_change", F.lit(True)), "path", "left").join(by_path, "path", "left").crossJoin(F.broadcast(every))
    tagged = lambda ids, scope: F.concat(F.transform(ids, lambda i: F.concat(F.lit("req:"), i)), F.array(F.lit(f"req-scope:{scope}")))
    new = F.when(F.col("in_change").isNull(), _none()).when(F.col("own").isNotNull(), tagged(F.col("own"), "commits")).otherwise(tagged(F.col("every"), "open"))
    have = F.coalesce("tags", _none()) if "tags" in findings.columns else _none()
    return rows.select(*[F.col(f"`{c}`") for c in findings.columns if c != "tags"], F.concat(have, new).alias("tags"))


def by_requirement(findings: DataFrame) -> DataFrame:
    """[A5] (requirement, severities, titles): findings of each ``req:`` tag, and the unattributed ones inside the change.

    ``titles`` are the first three different ones by ``seq``.  No rows where no finding has such a tag.
    """
    ids = F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit("req:"))), lambda t: F.substr(t, F.lit(5)))
    rows = findings.select("seq", "severity", "title", "tags", ids.alias("ids"))
    any_tag = rows.agg(F.bool_or(F.size("ids") > 0).alias("some")).filter("some").select("some")
    named = rows.select("seq", "severity", "title", F.explode("ids").alias("requirement"))
    rest = rows.filter((F.size("ids") == 0) & ~F.array_contains("tags", "outside-this-change")).select("seq", "severity", "title", F.lit("unattributed").alias("requirement"))
    parts = named.unionByName(rest)
    counts = parts.groupBy("requirement").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    first = parts.groupBy("requirement", "title").agg(F.min("seq").alias("seq")).withColumn("k", F.row_number().over(Window.partitionBy("requirement").orderBy("seq"))).filter("k <= 3")
    titles = first.groupBy("requirement").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("t")).select("requirement", F.col("t.title").alias("titles"))
    return counts.join(titles, "requirement").join(any_tag).select("requirement", *SEVERITIES, "titles")  # one row or none


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """[A6] Rows with ``group``, the first ``order`` of their key: sorted by it, rows of a key stand together in first-seen order."""
    return df.join(df.groupBy(*keys).agg(F.min(order).alias("group")), keys)


def requirement_activity(commits: DataFrame, cites: DataFrame) -> DataFrame:
    """[A18] Per requirement of cites(hash, id): first and last date and number of commits(hash, date)."""
    return cites.select("hash", "id").distinct().join(commits.select("hash", "date"), "hash").groupBy("id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("commits"))


def fix_pairs(before: DataFrame, after: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """[J18] Findings gone by (rule_id, path, logical) from a file that changed and is still there; of equal ones the last by ``seq``."""
    key = ["rule_id", "path", "logical"]
    rest = [c for c in before.columns if c not in key]
    last = before.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")
    return last.join(after.select(*key), key, "left_anti").join(changed.select("path"), "path", "left_semi").join(deleted.select("path"), "path", "left_anti").select(*before.columns)


def merge_reports(findings: DataFrame) -> DataFrame:
    """[J19] One row per id over several reports: id, status, line, sources, tags.

    ``findings`` has id, seq, report, position (0: the base), newer (at least as new as the base), status,
    line and tags.  The first report that holds an id gives the row; newer ones override status and
    line, and every report adds its tags and name.
    """
    order = F.struct("position", "seq")
    ruling = F.col("newer") | (F.col("position") == 0)
    pick = lambda value, test: F.max_by(value, F.when(test, order))
    listed = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("position", "seq", F.col(value).alias("v")))), lambda x: x["v"])
    per = findings.groupBy("id").agg(
        F.coalesce(pick(F.struct("status"), ruling), F.min_by(F.struct("status"), order)).alias("s"),
        F.coalesce(pick(F.col("line"), ruling & F.col("line").isNotNull()), F.min_by("line", order)).alias("line"),
        F.array_distinct(listed("report")).alias("sources"),
        F.array_distinct(F.flatten(listed("tags"))).alias("tags"),
    )
    return per.select("id", "s.status", "line", "sources", "tags")


def collapse_paths(files: DataFrame, every: DataFrame, floor: str = "") -> DataFrame:
    """[U6] The fewest directories (below ``floor``) that hold these files(path) and no other of ``every``; files without one stay.

    A directory below a pure one is pure, so the shortest pure directory of a file is its answer.
    """
    tests = files.select("path").distinct()
    up = lambda df: df.select("path", F.explode(directories(F.col("path"))).alias("folder"))
    total = up(every.select("path").distinct()).groupBy("folder").agg(F.count("*").alias("n"))
    own = up(tests).groupBy("folder").agg(F.count("*").alias("k"))
    pure = own.join(total, "folder").filter((F.col("k") == F.col("n")) & (F.col("folder") != floor))
    if floor:
        pure = pure.filter(~F.startswith(F.lit(floor), F.concat("folder", F.lit("/"))))
    best = up(tests).join(pure.select("folder"), "folder").groupBy("path").agg(F.min_by("folder", F.length("folder")).alias("folder"))
    return tests.join(best, "path", "left").select(F.coalesce("folder", "path").alias("path")).distinct()


def draft_ledger(findings: DataFrame, confirmed: DataFrame, ledger: DataFrame, prefix: str = "FAIL") -> DataFrame:
    """[L17, W8] (failure, id, title): an open entry for each confirmed finding that no entry of ledger(id, text) refers to.

    Numbers go on from the ledger's highest one, in the order of ``seq``; one batch of a reviewer's
    verdicts is numbered in one task.
    """
    named = ledger.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(f:[0-9a-f]{12})\b"), 1)).alias("id")).distinct()
    some = findings.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"))
    new = some.join(confirmed.select("id").distinct(), "id", "left_semi").join(named, "id", "left_anti")
    last = ledger.agg(F.coalesce(F.max(F.regexp_extract("id", f"^{prefix}-([0-9]+)$", 1).try_cast("int")), F.lit(0)).alias("last"))
    numbered = new.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq"))).crossJoin(F.broadcast(last))  # one row
    number = (F.col("last") + F.col("k")).cast("string")
    return numbered.select(F.concat(F.lit(f"{prefix}-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("failure"), "id", "title")


def in_scope(findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """[P12] Findings without a path, or with one of the inventory."""
    known = inventory.select("path").distinct().withColumn("_known", F.lit(True))
    return findings.join(known, "path", "left").filter("_known OR coalesce(path, '') = ''").drop("_known")


def native_cwe(findings: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """[P9] Fills an empty ``cwe`` from the longest rule pattern (glob) that fits; of equal lengths the first."""
    from corvid.functions.scalars import file_glob

    found = _none()
    for pattern in reversed(sorted(patterns, key=len, reverse=True)):
        found = F.when(F.col("rule_id").rlike(file_glob(pattern)), F.array(*[F.lit(c) for c in patterns[pattern]])).otherwise(found)
    return findings.withColumn("cwe", F.when(F.size(F.coalesce("cwe", _none())) > 0, F.col("cwe")).otherwise(found))


def scope_notes(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """[P14] Findings with ``scope_note``: the first note(repo_id, prefix, text, seq) of the repository whose prefix covers the path."""
    clean = lambda c: F.regexp_replace(F.trim(c), "^/+|/+$", "")
    keyed = notes.select("repo_id", clean(F.col("prefix")).alias("place"), "text", F.col("seq").alias("note_seq")).filter("place <> ''")
    paths = findings.filter("coalesce(path, '') <> ''").select("repo_id", "path").distinct()
    near = paths.withColumn("place", F.explode(F.concat(directories(clean(F.col("path"))), F.array(clean(F.col("path"))))))
    best = near.join(keyed, ["repo_id", "place"]).groupBy("repo_id", "path").agg(F.min_by("text", "note_seq").alias("scope_note"))
    return findings.join(best, ["repo_id", "path"], "left")


def registry_problems(entries: DataFrame, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """[P19] (id, problem): ids that stand twice, and references that lead nowhere.

    Each reference is (name, known, column): values of the array ``column`` must be an ``id`` of ``known``.
    """
    twice = entries.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    for name, known, column in references:
        used = entries.select("id", F.explode(column).alias("ref")).distinct()
        lost = used.join(known.select(F.col("id").alias("ref")), "ref", "left_anti")
        twice = twice.unionByName(lost.select("id", F.concat(F.lit(f"{name} "), "ref").alias("problem")))
    return twice


def search(records: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """[P15] Records that hold a text in any of the fields, whatever its case, with the fields' names in ``matched``."""
    text = lambda c: F.lower(F.coalesce(F.array_join(c, " ") if dict(records.dtypes)[c].startswith("array") else F.col(c).cast("string"), F.lit("")))
    hit = F.array_compact(F.array(*[F.when(F.contains(text(c), F.lit(needle.lower())), F.lit(c)) for c in fields]))
    return records.withColumn("matched", hit).filter("size(matched) > 0")


def list_records(records: DataFrame, status: str | None = None, last: int | None = None) -> DataFrame:
    """[P16] Records of a status; the last ``last`` by ``seq``."""
    some = records.filter(F.col("status") == status) if status else records
    return some.orderBy(F.desc("seq")).limit(last) if last else some


def scan_statistics(files: DataFrame) -> DataFrame:
    """[A11] One row over files(lines, read, changed): totals, what a partial scan read, and the share of lines."""
    f, n = F.col, lambda test: F.count_if(test)
    total = F.sum("lines")
    read = F.sum(F.when(f("read"), f("lines")).otherwise(0))
    return files.agg(F.count("*").alias("files"), n(f("read")).alias("files_read"), n(f("changed")).alias("changed"), n(f("read") & ~f("changed")).alias("context"), total.alias("lines"), read.alias("lines_read"), F.round(F.when(total > 0, read / total).otherwise(0.0), 4).alias("share"))


# Files that are read whether or not they changed, as others are judged by them.
CONTEXT_ROLES = ["ci"]
CONTEXT_NAMES = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json",
    "requirements.txt", "requirements-dev.txt", "pyproject.toml", "setup.py",
    "setup.cfg", "Pipfile", "Pipfile.lock", "poetry.lock", "uv.lock",
    "go.mod", "go.sum", "go.work", "Gemfile", "Gemfile.lock",
    "composer.json", "composer.lock", "Cargo.toml", "Cargo.lock",
    "pom.xml", "build.gradle", "build.gradle.kts", "gradle.lockfile",
    "Dockerfile", "Containerfile", "docker-compose.yml", "docker-compose.yaml",
    "Makefile", "Jenkinsfile", "cdk.json",
]
CONTEXT_ENDINGS = [".tf", ".tfvars", ".hcl"]


def changed_paths(outputs: list[DataFrame]) -> DataFrame:
    """[I1] (repo_id, path): the paths that any of several lists(repo_id, text), a path a line, names: commits since the reference, work in the tree and in the index, new files."""
    every = reduce(DataFrame.unionByName, [x.select("repo_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("path")) for x in outputs])
    return every.select("repo_id", F.regexp_replace("path", r"^\s+|\s+$", "").alias("path")).filter("path <> ''").distinct()


def is_context(path: Column, role: Column, binary: Column) -> Column:
    """[I6] Whether others are judged by a file: CI, manifests and lock files, declared infrastructure."""
    name = F.substring_index(path, "/", -1)
    ending = reduce(lambda a, b: a | b, [F.endswith(F.lower(path), F.lit(e)) for e in CONTEXT_ENDINGS])
    return ~binary & (role.isin(CONTEXT_ROLES) | name.isin(CONTEXT_NAMES) | F.startswith(name, F.lit("Dockerfile")) | ending)


def narrowed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """[I6] ``files`` (repo_id, path, role, binary, lines, ...) with ``changed`` and ``read``: a partial scan reads what changed, and what others are judged by.  ``scan_statistics`` sums it up."""
    hit = changed.select("repo_id", "path").distinct().withColumn("changed", F.lit(True))
    rows = files.join(hit, ["repo_id", "path"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return rows.withColumn("read", F.col("changed") | is_context(F.col("path"), F.col("role"), F.col("binary")))


def combined_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """[I16] One digest for each key over files(path, digest), whatever their order in the table.

    Digests of paths are folded by 256 leading letters first, so that no task reads all files of a key.
    """
    line = F.concat_ws("\t", "path", "digest")
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    part = files.groupBy(*keys, F.substring(F.sha2("path", 256), 1, 2).alias("part")).agg(fold(line).alias("d"))
    return part.groupBy(*keys).agg(fold(F.concat_ws("\t", "part", "d")).alias("digest"))


def cache_split(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[I8, Z4] (hits, misses) of work(key): what the cache(key, result) holds, and what is to be done."""
    known = cache.groupBy("key").agg(F.max("result").alias("result"))
    return work.join(known, "key"), work.join(known.select("key"), "key", "left_anti")
