"""Findings of two arms matched one to one, and findings held against what was expected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import token_jaccard, token_set
from corvid.operators.graphs import cut

TOLERANCE, WORDING = 2, 0.5


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _greedy(rows: pd.DataFrame, tolerance: int, wording: float) -> Iterator[tuple]:
    """(how, a, b) of the rows of one file: by line first, then by wording; each in the order of the left side."""
    a = rows[rows["side"] == 0].sort_values("place").to_dict("records")
    b = {r["seq"]: r for r in rows[rows["side"] == 1].sort_values("place").to_dict("records")}
    left = []
    for f in a:
        line = f["line"]
        hit = next((k for k, g in b.items() if g["line"] and abs(g["line"] - line) <= tolerance), None) if f["path"] and line else None
        if hit is None:
            left.append(f)
        else:
            del b[hit]
            yield "location", f["seq"], hit
    words = {k: frozenset(g["words"]) for k, g in b.items()}
    for f in left:
        own, best, score = frozenset(f["words"]), None, 0.0
        for k in b:
            s = _jaccard(own, words[k])
            if s > score:
                best, score = k, s
        if best is not None and score >= wording:
            del b[best]
            yield "wording", f["seq"], best


def match(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE, wording: float = WORDING) -> DataFrame:
    """[J12] (how, a, b) of findings(seq, id, repo_id, path, start_line, title, rule_id); each is used once.

    First equal ids, the n-th with the n-th.  Then, inside one file, the first one within ``tolerance``
    lines, and at last the one with the most similar wording of at least ``wording``.  The two later
    passes go through a file's rows in order, in one task; files are spread.  Rows that are in no pair
    stand with a null on the other side, how ``only_a`` or ``only_b``.
    """
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seq")))
    first = b.groupBy("id").agg(F.min("seq").alias("first"))
    left, right = nth(a), nth(b)
    same = cut(left.select("id", "n", F.col("seq").alias("a")).join(right.select("id", "n", F.col("seq").alias("b")), ["id", "n"]))
    words = token_set(F.concat("title", F.lit(" "), F.substring_index("rule_id", "/", -1)))
    cols = lambda df, side, place: df.select(F.lit(side).alias("side"), "seq", place.alias("place"), "repo_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("start_line", F.lit(0)).cast("long").alias("line"), words.alias("words"))
    rest_a = cols(a.join(same.select(F.col("a").alias("seq")), "seq", "left_anti"), 0, F.struct(F.col("seq").alias("x"), F.col("seq").alias("y")))
    # Unused right rows come in the order in which their ids were first met.
    rest_b = cols(b.join(same.select(F.col("b").alias("seq")), "seq", "left_anti").join(first, "id"), 1, F.struct(F.col("first").alias("x"), F.col("seq").alias("y")))
    rows = rest_a.unionByName(rest_b).withColumn("place", F.concat(F.lpad(F.col("place.x").cast("string"), 20, "0"), F.lpad(F.col("place.y").cast("string"), 20, "0")))
    both = rows.groupBy("repo_id", "path").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo < hi").select("repo_id", "path")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_greedy(part, tolerance, wording)), columns=["how", "a", "b"]).astype({"a": "int64", "b": "int64"})

    near = cut(rows.join(both, ["repo_id", "path"]).groupBy("repo_id", "path").applyInPandas(run, "how string, a long, b long"))
    pairs = same.select(F.lit("fingerprint").alias("how"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).unionByName(near)
    none = F.lit(None).cast("long")
    only_a = a.select(F.col("seq").cast("long").alias("a")).join(pairs.select("a"), "a", "left_anti").select(F.lit("only_a").alias("how"), "a", none.alias("b"))
    only_b = b.select(F.col("seq").cast("long").alias("b")).join(pairs.select("b"), "b", "left_anti").select(F.lit("only_b").alias("how"), none.alias("a"), "b")
    return pairs.unionByName(only_a).unionByName(only_b)


def agreement(matches: DataFrame) -> DataFrame:
    """[A19] One row: pairs by kind, rows of one side only, and the share of pairs (1 where there is nothing)."""
    n = lambda how: F.count_if(F.col("how") == how)
    kinds = ["fingerprint", "location", "wording", "only_a", "only_b"]
    pairs = n("fingerprint") + n("location") + n("wording")
    return matches.agg(*[n(k).alias(k) for k in kinds], F.round(F.when(F.count("*") > 0, pairs / F.count("*")).otherwise(1.0), 4).alias("agreement"))


def wording_pairs(a: DataFrame, b: DataFrame, least: float = WORDING) -> DataFrame:
    """[J12, F13] (a, b, score): titles of rows(key, title) of one key whose word sets are similar enough."""
    words = lambda df, n: df.select("key", F.col("seq").alias(n), token_set(F.col("title")).alias(f"w{n}"))
    return words(a, "a").join(words(b, "b"), "key").withColumn("score", token_jaccard(F.col("wa"), F.col("wb"))).filter(F.col("score") >= least).select("a", "b", "score")


def ground_truth(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """[J13] (item, seq): each item of expected(item, path, match, dimension) with the first finding that no earlier item took; seq is null if none.

    An item fits a finding by path (equal, or the end of the finding's), by every part of ``match``
    between &-signs in its texts, and by dimension.  All items choose at once, a finding keeps its
    earliest item, and the others go on to their next finding: the outcome is that of one item after
    the other.
    """
    hay = F.lower(F.concat_ws(" ", "rule_id", "title", F.coalesce("description", F.lit("")), F.coalesce("logical", F.lit(""))))
    rows = findings.select("seq", "path", "dimension", hay.alias("hay"))
    items = expected.select("item", F.coalesce("path", F.lit("")).alias("want"), F.transform(F.split(F.lower(F.coalesce("match", F.lit(""))), "&"), F.trim).alias("needles"), F.coalesce("dimension", F.lit("")).alias("dim"))
    parts = F.split("path", "/")
    ends = rows.withColumn("want", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/")))))
    fits = F.forall("needles", lambda x: F.contains(F.col("hay"), x)) & ((F.col("dim") == "") | (F.col("dim") == F.col("dimension")))
    # Items without a path meet all findings, which are dealt out so that no task has them all.
    dealt = ends.withColumn("salt", F.when(F.col("want") == "", F.pmod("seq", F.lit(32)).cast("int")).otherwise(0))
    sent = items.withColumn("salt", F.explode(F.when(F.col("want") == "", F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(0)))))
    open_ = cut(dealt.join(sent, ["want", "salt"]).filter(fits).select("item", "seq").distinct())
    held = cut(open_.limit(0))
    while True:
        asks = open_.join(held.select("item"), "item", "left_anti").groupBy("item").agg(F.min("seq").alias("seq"))
        both = cut(asks.select("item", "seq").unionByName(held))
        won = cut(both.groupBy("seq").agg(F.min("item").alias("item")).select("item", "seq"))
        lost = cut(both.join(won, ["item", "seq"], "left_anti"))
        same = lost.isEmpty() and won.count() == held.count()
        open_, held = cut(open_.join(lost, ["item", "seq"], "left_anti")), won
        if same:
            return expected.select("item").join(held, "item", "left")


def recall_precision(truth: DataFrame, findings: DataFrame, exhaustive: bool) -> DataFrame:
    """[A20] One row: expected, found, unexpected, recall, and precision and F1 where the list is exhaustive."""
    n = truth.agg(F.count("*").alias("expected"), F.count("seq").alias("found")).crossJoin(findings.agg(F.count("*").alias("all")))  # one row each
    found, unexpected = F.col("found"), F.col("all") - F.col("found")
    recall = F.when(F.col("expected") > 0, found / F.col("expected")).otherwise(0.0)
    precision = F.when(F.lit(exhaustive), F.when(F.col("all") > 0, found / F.col("all")).otherwise(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(precision.isNotNull(), 0.0)
    return n.select("expected", "found", unexpected.alias("unexpected"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def markers(files: DataFrame, marker: str = r"expect:\s*([\w./, -]+)") -> DataFrame:
    """[S25] (path, line, rule) of the rules that comments in files(path, text) announce."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rules = F.split(F.regexp_extract("text", marker, 1), ",")
    return lines.filter(F.col("text").rlike(marker)).select("path", (F.col("line") + 1).alias("line"), F.explode(rules).alias("rule")).withColumn("rule", F.trim("rule")).filter("rule <> ''")


def planted(marks: DataFrame, findings: DataFrame) -> DataFrame:
    """[J14] (rule, path, line, state): markers that a finding's lines hold are caught, others missed; findings of a marked rule on other lines are unexpected."""
    f = findings.select(F.col("rule_id").alias("rule"), "path", "start_line", F.greatest("start_line", F.coalesce("end_line", "start_line")).alias("end_line"))
    near = f.withColumn("line", F.explode(F.sequence("start_line", "end_line"))).select("rule", "path", "line").distinct().withColumn("hit", F.lit(True))
    state = marks.join(near, ["rule", "path", "line"], "left").select("rule", "path", "line", F.when(F.col("hit"), "caught").otherwise("missed").alias("state"))
    other = f.join(marks.select("rule").distinct(), "rule", "left_semi").select("rule", "path", F.col("start_line").alias("line")).distinct().join(marks, ["rule", "path", "line"], "left_anti")
    return state.unionByName(other.withColumn("state", F.lit("unexpected")))
