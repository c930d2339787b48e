"""What a graph says about one node: its neighbourhood, its description, and why it is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.graphs import cut, resolve_one

# Fields that a description shows, of every kind and of some kinds only.
COMMON_FIELDS = ["status", "date", "severity", "framework"]
KIND_FIELDS = {"finding": ["rule_id", "dimension", "line", "cwe", "traced_to"], "finding_rule": ["probe", "cwe", "findings", "requirements"]}
# Sections of an answer, by the node's kind and the type of its edges; "" stands for all other types.
SECTIONS_OUT = {
    "requirement": {"touches": "files touched"},
    "failure": {"affects": "affected code", "arose_in": "requirement", "prevented_by": "prevented by", "fixed_by": "fix commits", "recurs": "repeats"},
    "changelog": {"records": "requirements", "": "files mentioned"},
    "commit": {"delivers": "requirements", "modifies": "files modified", "logged_in": "changelog entries", "follows": "previous commit"},
    "suite": {"contains": "test files", "covers": "covers", "guards": "guards"},
    "rulepack": {"defines": "rules"},
    "finding": {"flags": "flagged code", "cites": "requirement", "recorded_as": "failure", "violates": "rule", "classified_as": "cwe", "introduced_by": "introduced by"},
    "finding_rule": {"classified_as": "cwe", "specified_by": "specified by"},
}
SECTIONS_IN = {
    "requirement": {"records": "changelog", "delivers": "commits", "arose_in": "failures", "specified_by": "finding rules"},
    "failure": {"guards": "regression tests", "recurs": "repeated by"},
    "changelog": {"logged_in": "commits"},
    "commit": {"follows": "next commit"},
    "rule": {"prevented_by": "failures it prevents", "defines": "rules"},
    "finding_rule": {"violates": "findings", "mentions_rule": "changelog"},
    "cwe": {"classified_as": "rules"},
}
CODE_IN = {"modifies": "commits", "prevented_by": "failures it prevented", "flags": "findings", "covers": "test suites"}
TESTABLE = ["module", "class", "function", "method", "interface"]
ROW = "section string, id string, via string, rank int"


def neighbourhood(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """[G2] (way, type, id, kind, name) of every edge of the one node that ``text`` names; no rows if it names none or several."""
    node = resolve_one(nodes, text).first()
    me = node["id"] if node else None
    out = edges.filter(F.col("source") == me).select(F.lit("out").alias("way"), "type", F.col("target").alias("id"))
    into = edges.filter(F.col("target") == me).select(F.lit("in").alias("way"), "type", F.col("source").alias("id"))
    return out.unionByName(into).join(nodes.select("id", "kind", "name"), "id", "left").select("way", "type", "id", "kind", "name")


def describe(nodes: DataFrame) -> DataFrame:
    """[P4] id, kind, name, file and a map of the fields that nodes of this kind show, where they have a value."""
    has = lambda names: [n for n in names if n in nodes.columns]
    fields: dict[str, Column] = {n: F.col(n).cast("string") for n in has(COMMON_FIELDS)}
    for kind, names in KIND_FIELDS.items():
        for n in has(names):
            fields[n] = F.coalesce(F.when(F.col("kind") == kind, F.col(n).cast("string")), fields.get(n, F.lit(None).cast("string")))
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fields.items()])
    shown = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")) if fields else F.create_map().cast("map<string,string>")
    return nodes.select("id", "kind", "name", F.nullif("file", F.lit("")).alias("file"), shown.alias("fields"))


def _rows(df: DataFrame, section: Column | str, other: str, via: Column | str = "", rank: Column | int = 0) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(section).alias("section"), F.col(other).alias("id"), F.coalesce(lit(via), F.lit("")).alias("via"), lit(rank).cast("int").alias("rank"))


def _sections(edges: DataFrame, table: dict[str, str], other: str, via: Column | str = "") -> list[DataFrame]:
    named = [t for t in table if t]
    out = [_rows(edges.filter(F.col("type") == t), table[t], other, via) for t in named]
    return out + [_rows(edges.filter(~F.col("type").isin(named)), table[""], other, via)] if "" in table else out


def why(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """[G4, X3] (section, id, kind, name, via): what requirements, commits, tests, failures and rules say about a node.

    ``nodes`` has id, kind, name, file, directory and test (booleans); ``edges`` source, target, type,
    provenance.  A node is listed once in a section.  No rows if ``text`` names no node or several.
    """
    node = resolve_one(nodes, text).first()
    spark = nodes.sparkSession
    if node is None:
        return spark.createDataFrame([], "section string, id string, kind string, name string, via string")
    me, kind = node["id"], node["kind"]
    edges = cut(edges.select("source", "target", "type", "provenance"))  # made once for all sections
    mine = cut(edges.filter((F.col("source") == me) | (F.col("target") == me)))
    out, into = mine.filter(F.col("source") == me), mine.filter(F.col("target") == me)
    of = lambda ends, side: edges.join(ends.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    parts: list[DataFrame] = []
    if kind in SECTIONS_OUT or kind in SECTIONS_IN:
        via: Column | str = F.when(F.col("provenance") == "EXTRACTED", "declared scope").otherwise("git history") if kind == "requirement" else ""
        parts += _sections(out, SECTIONS_OUT.get(kind, {}), "target", via)
        parts += _sections(into, SECTIONS_IN.get(kind, {}), "source")
    if kind == "requirement":
        rules = into.filter("type = 'specified_by'").select(F.col("source").alias("id"))
        parts.append(_rows(of(rules, "target").filter("type = 'violates'"), "findings", "source"))
    elif kind == "finding":
        rules = out.filter("type = 'violates'").select(F.col("target").alias("id"))
        parts.append(_rows(of(rules, "source").filter("type = 'specified_by'"), "traced to", "target"))
    elif kind in ("cwe", "finding_rule"):
        raised = into.join(nodes.filter("kind = 'finding'").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"))
        parts = [p if kind != "cwe" else p.join(nodes.filter("kind = 'finding_rule'").select("id"), "id", "left_semi") for p in parts]
        parts.append(_rows(raised, "findings", "id"))
        files = nodes.filter("kind IN ('file', 'module')").select(F.col("id").alias("target"))
        parts.append(_rows(of(raised, "source").filter("type = 'flags'").join(files, "target", "left_semi"), "files", "target"))
    elif not parts:
        parts = _code_sections(nodes, edges, node, of)
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ROW)
    once = rows.filter(F.col("id") != me).groupBy("section", "id").agg(F.min_by("via", F.struct("rank", "via")).alias("via"))
    listed = once.join(nodes.select("id", "kind", "name"), "id").select("section", "id", "kind", "name", "via")
    if kind in TESTABLE and not node["test"]:
        none = listed.agg(F.count_if(F.col("section") == "tests").alias("n")).filter("n = 0")
        listed = listed.unionByName(none.select(F.lit("gaps").alias("section"), F.lit("-").alias("id"), F.lit("gap").alias("kind"), F.lit("no test references this").alias("name"), F.lit("").alias("via")))
    return listed


def _code_sections(nodes: DataFrame, edges: DataFrame, node, of) -> list[DataFrame]:
    """Sections of a file or symbol: its own, its containers' (eight at most) and its directories' edges, and those of its file's symbols."""
    me, path = node["id"], node["file"] or ""
    anchors = [me]
    for _ in range(8):
        parent = edges.filter((F.col("type") == "defines") & (F.col("target") == anchors[-1])).agg(F.min("source")).first()[0]
        if parent is None or parent in anchors:
            break
        anchors.append(parent)
    above = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)]
    folders = {r["id"]: r["file"] for r in nodes.filter((F.col("kind") == "file") & F.col("directory") & F.col("file").isin(above)).select("id", "file").collect()} if above else {}
    # All edges into the file's symbols, its containers and directories; then those around what stands at their other end.
    here = nodes.filter(F.col("file") == path).select("id") if node["kind"] in ("module", "file") and path else nodes.limit(0).select("id")
    scan = here.union(nodes.filter(F.col("id").isin([*anchors, *folders])).select("id"))
    seen = cut(of(scan, "target"))
    around = seen.filter(F.col("target").isin([*anchors, *folders]))
    folder = F.lit(None).cast("string")
    for i, f in folders.items():
        folder = F.when(F.col("target") == i, f).otherwise(folder)
    touches = around.filter("type = 'touches'")
    rank = F.when(F.col("provenance") == "INFERRED", 0).when(folder.isNotNull(), 3).when(F.col("target") == me, 1).otherwise(2)
    words = F.when(rank == 0, "changed in git history").when(rank == 3, F.concat(F.lit("directory scope "), folder)).when(rank == 1, "declared scope").otherwise("declared scope (containing file)")
    needs = _rows(touches, "requirements", "source", words, rank)
    close = needs.groupBy("id").agg(F.min("rank").alias("rank")).filter("rank <= 2").select("id")
    mentions = around.filter("type = 'mentions'").join(nodes.select(F.col("id").alias("source"), F.col("kind").alias("by")), "source")
    tests, failures = _rows(seen.filter("type = 'verifies'"), "tests", "source"), _rows(seen.filter("type = 'affects'"), "failures", "source")
    parts = [needs, _rows(mentions, F.when(F.col("by") == "changelog", "changelog").otherwise("docs"), "source", "names this file"), tests, failures]
    parts += _sections(around, CODE_IN, "source")
    ends = F.explode(F.array(F.struct(F.lit("target").alias("way"), F.col("target").alias("id"), F.col("source").alias("other")), F.struct(F.lit("source").alias("way"), F.col("source").alias("id"), F.col("target").alias("other"))))
    groups = tests.select("id", F.lit("test").alias("role")).unionByName(failures.select("id", F.lit("failure").alias("role"))).unionByName(close.select("id", F.lit("need").alias("role"))).distinct()
    wanted = [("need", "target", "records", "changelog", ""), ("test", "target", "contains", "test suites", ""), ("failure", "source", "prevented_by", "rules and playbooks from those failures", ""), ("failure", "target", "guards", "tests", "regression test")]
    further = cut(edges.filter(F.col("type").isin([w[2] for w in wanted])).select("type", ends.alias("e")).select("type", "e.*").join(groups, "id"))
    for role, way, kind, section, via in wanted:
        parts.append(_rows(further.filter((F.col("role") == role) & (F.col("way") == way) & (F.col("type") == kind)), section, "other", via))
    return parts
