"""Rule evidence, discrimination, percentiles, history and component scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import wilson_lower


def rule_stats(verdicts: DataFrame, by: str, proven_at: int = 20) -> DataFrame:
    """[L3] Per rule of verdicts(by, truth boolean): observations, precision and its Wilson bound, proven."""
    per = verdicts.groupBy(by).agg(F.count_if("truth").alias("tp"), F.count_if(~F.col("truth")).alias("fp"))
    n = F.col("tp") + F.col("fp")
    return per.select(by, "tp", "fp", n.alias("n"), F.when(n > 0, F.round(F.col("tp") / n, 6)).alias("precision"), F.round(wilson_lower(F.col("tp"), n), 6).alias("bound"), (n >= proven_at).alias("proven"))


def record_verdicts(known: DataFrame, new: DataFrame) -> DataFrame:
    """[L4] Known verdicts, and the first new one for each id that has none; without a reviewer it is refused."""
    fresh = new.filter("coalesce(trim(reviewer), '') <> ''").join(known.select("id"), "id", "left_anti")
    rest = [c for c in known.columns if c != "id"]
    first = fresh.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")
    return known.unionByName(first.select(*known.columns))


def recalibrated(confidence: Column, precision: Column, proven: Column) -> Column:
    """[L5] Measured precision replaces a proven rule's confidence: 0.90 and 0.65 are the borders."""
    return F.when(~F.coalesce(proven, F.lit(False)), confidence).when(precision >= 0.90, "high").when(precision >= 0.65, "medium").otherwise("low")


def discrimination(hits: DataFrame, sizes: DataFrame, rule: str, language: str, population: str, good: str, bad: str, thin: int = 5, least: float = 1.5) -> DataFrame:
    """[L6, X12] Hits per 1000 units of the languages that a rule fires on, in either population, and their ratio.

    ``hits`` has a row per hit; ``sizes`` (language, population, size).
    """
    langs = hits.select(rule, language).distinct()
    total = sizes.groupBy(language, population).agg(F.sum("size").alias("size"))
    denominators = langs.join(total, language).groupBy(rule).agg(*[F.sum(F.when(F.col(population) == p, F.col("size"))).alias(f"size_{t}") for p, t in ((good, "good"), (bad, "bad"))])
    counts = hits.groupBy(rule).agg(*[F.count_if(F.col(population) == p).alias(f"hits_{t}") for p, t in ((good, "good"), (bad, "bad"))])
    rate = lambda t: F.when(F.col(f"size_{t}") > 0, F.col(f"hits_{t}") * 1000 / F.col(f"size_{t}"))
    out = counts.join(denominators, rule).withColumn("g", rate("good")).withColumn("b", rate("bad"))
    ratio = F.when(F.col("b").isNull() | (F.col("b") == 0), None).when(F.col("g").isNull() | (F.col("g") == 0), float("inf")).otherwise(F.col("b") / F.col("g"))
    few = F.col("hits_good") + F.col("hits_bad") < thin
    return out.withColumn("ratio", ratio).select(rule, "hits_good", "hits_bad", F.round("ratio", 6).alias("ratio"), few.alias("thin"), (~few & F.col("ratio").isNotNull() & (F.col("ratio") < least)).alias("unsupported"))


def percentiles(df: DataFrame, value: str, keys: list[str], shares: tuple[float, ...] = (0.90, 0.95, 0.99), bins: int = 4096) -> DataFrame:
    """[W7] The sorted value at index min(n - 1, int(p n)), and the median, exactly.

    Values are counted in ``bins`` equal ranges of each key first; only the ranges that hold a wanted
    index are ranked value by value, so that no task sorts all rows of a key.
    """
    some = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    edges = some.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    n = F.col("n")
    wanted = {f"p{round(p * 100)}": F.least(n - 1, F.floor(F.lit(p) * n)) for p in shares} | {"_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2)}
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = some.join(edges, keys) if keys else some.crossJoin(F.broadcast(edges))
    counts = binned.withColumn("bin", place).groupBy(*keys, "bin", "lo", "hi", "n").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows a key
    ranged = counts.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    indexes = F.array_distinct(F.array(*[w.cast("long") for w in wanted.values()]))
    held = ranged.withColumn("held", F.filter(indexes, lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("c")))).filter("size(held) > 0").select(*keys, "bin", "before", "held")
    inside = binned.withColumn("bin", place).join(held, [*keys, "bin"]).groupBy(*keys, "bin", "v", "before").agg(F.count("*").alias("c"), F.first("held").alias("held"), F.first("n").alias("n"))
    run = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("v")))
    at = lambda i: F.min(F.when((i >= F.col("upto") - F.col("c")) & (i < F.col("upto")), F.col("v")))
    out = run.groupBy(*keys).agg(F.max("n").alias("n"), *[at(w).alias(name) for name, w in wanted.items()])
    return out.select(*keys, "n", *[f"p{round(p * 100)}" for p in shares], ((F.col("_m1") + F.col("_m2")) / 2).alias("median"))


def history(findings: DataFrame, day: Column) -> DataFrame:
    """[A17] One row per day: findings and counts by severity."""
    from corvid.operators.findings import severity_counts

    return severity_counts(findings.withColumn("day", day), ["day"])


def recent(df: DataFrame, date: str, days: int) -> DataFrame:
    """[W6] Rows of the last ``days`` days before the latest date."""
    last = df.agg(F.max(date).alias("last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(date) >= F.date_sub("last", days)).drop("last")  # one row


#: How broad the use by 0 to 8 users is; Spark's quotient of logarithms is off by a last digit, which decides where a score is rounded from a half.
BREADTH = [math.log2(1 + users) / math.log2(9) for users in range(9)]


def reuse_score(users: Column, components: Column, applications: Column, fan_out: Column, category: Column) -> Column:
    """[L12] 0 to 100: breadth of use, reach over other components, use by other applications, few dependencies; 0 at the top of the tree."""
    breadth = F.get(F.array(*map(F.lit, BREADTH)), F.least(users.cast("int"), F.lit(8)))
    reach = F.least(F.lit(1.0), components / 3)
    portable = F.when(applications > 0, 1.0).otherwise(0.0)
    score = F.bround(100 * (0.30 * breadth + 0.25 * reach + 0.25 * portable + 0.20 / (1 + fan_out / 5)), 0).cast("int")
    return F.when(category.isin("entry-point", "framework-wired", "top-level"), 0).otherwise(score)


def reuse_category(applications: Column, components: Column, shared: Column, users: Column, entry: Column, wired: Column, tests: Column) -> Column:
    """[L12, X8] A module's category: the first that fits."""
    return (
        F.when(applications > 0, "cross-app").when((components >= 2) | (shared & (users > 0)), "shared").when(users >= 2, "reused").when(users == 1, "single-use")
        .when(entry, "entry-point").when(wired, "framework-wired").when(shared, "shared").when(tests > 0, "test-only").otherwise("unreferenced")
    )


def calibrated_severity(hits: DataFrame, sizes: DataFrame, least: int = 5, repos: int = 2) -> DataFrame:
    """[L7] Severity of an external check from how much more often it fires in vulnerable code than in clean code.

    ``hits`` has rule, language, repo and population; ``sizes`` lines by language and population.  Lines
    are those of the languages that a rule fires on, else all.  Ten times: medium, three: low, else
    info; seen in fewer than ``repos`` repositories at most low; under ``least`` hits no severity.
    """
    pops = ("clean", "vulnerable")
    counted = hits.groupBy("rule").agg(*[F.count_if(F.col("population") == p).alias(p) for p in pops], F.countDistinct("repo").alias("repos")).filter("clean + vulnerable > 0")
    total = sizes.groupBy("language", "population").agg(F.sum("lines").alias("lines"))
    spoken = hits.select("rule", "language").distinct().join(total, "language").groupBy("rule").agg(*[F.sum(F.when(F.col("population") == p, F.col("lines"))).alias(f"lines_{p}") for p in pops])
    whole = total.agg(*[F.sum(F.when(F.col("population") == p, F.col("lines"))).alias(f"all_{p}") for p in pops])
    rows = counted.join(spoken, "rule", "left").crossJoin(F.broadcast(whole))  # one row
    lines = {p: F.coalesce(F.nullif(F.col(f"lines_{p}"), F.lit(0)), F.col(f"all_{p}"), F.lit(0)) for p in pops}
    rate = {p: F.when(lines[p] > 0, F.col(p) * 1000 / lines[p]).otherwise(0.0) for p in pops}
    ratio = F.when(rate["vulnerable"] == 0, None).when(rate["clean"] == 0, float("inf")).otherwise(rate["vulnerable"] / rate["clean"])
    few = F.col("repos") < repos
    band = F.when(F.col("ratio").isNull() | (F.col("clean") + F.col("vulnerable") < least), None).when(F.col("ratio") >= 10, F.when(few, "low").otherwise("medium")).when(F.col("ratio") >= 3, "low").otherwise("info")
    return rows.withColumn("ratio", ratio).select("rule", "clean", "vulnerable", "repos", F.round("ratio", 2).alias("ratio"), band.alias("severity"))


def apply_knowledge(findings: DataFrame, severities: DataFrame, stats: DataFrame) -> DataFrame:
    """[L5] Findings with measured severity and confidence, and what was changed in ``tags``.

    ``severities`` (rule_id, measured) replace the tool's own; ``stats`` (rule_id, tp, fp) give the
    precision, and for rules with ``PROVEN_AT`` observations the confidence, by its Wilson bound.
    """
    from corvid.operators.findings import PROVEN_AT

    n = F.col("tp") + F.col("fp")
    rows = findings.join(severities.select("rule_id", "measured"), "rule_id", "left").join(stats.select("rule_id", "tp", "fp").filter("tp + fp > 0"), "rule_id", "left")
    graded = F.coalesce(F.col("measured") != F.col("severity"), F.lit(False))
    sure = recalibrated(F.col("confidence"), wilson_lower(F.col("tp"), n), n >= PROVEN_AT)
    moved = F.coalesce(sure != F.col("confidence"), F.lit(False))
    rows = rows.withColumns({"_graded": graded, "_sure": sure, "_moved": moved})
    said = [
        F.when(F.col("_graded"), F.concat(F.lit("severity-was:"), "severity")), F.when(F.col("_graded"), F.lit("severity:measured")),
        F.when(n > 0, F.format_string("precision:%.2f", F.col("tp") / n)), F.when(n > 0, F.concat(F.lit("n="), n.cast("string"))),
        F.when(F.col("_moved"), F.concat(F.lit("confidence-was:"), "confidence")),
    ]
    tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array_compact(F.array(*said)))
    changed = {"tags": tags, "severity": F.when(F.col("_graded"), F.col("measured")).otherwise(F.col("severity")), "confidence": F.when(F.col("_moved"), F.col("_sure")).otherwise(F.col("confidence"))}
    return rows.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in findings.columns])


def synthetic_stats(trials: DataFrame) -> DataFrame:
    """[L3, L8] Per rule of trials(rule_id, planted boolean, fired boolean): recall and specificity with their Wilson bounds."""
    n = lambda planted, fired: F.count_if((F.col("planted") == planted) & (F.col("fired") == fired))
    per = trials.groupBy("rule_id").agg(n(True, True).alias("detected"), n(True, False).alias("missed"), n(False, False).alias("clean_pass"), n(False, True).alias("false_alarm"))
    out = ["rule_id", "detected", "missed", "clean_pass", "false_alarm"]
    for name, good, bad in (("recall", "detected", "missed"), ("specificity", "clean_pass", "false_alarm")):
        total = F.col(good) + F.col(bad)
        out += [F.when(total > 0, F.round(F.col(good) / total, 6)).alias(name), F.when(total > 0, F.round(wilson_lower(F.col(good), total), 6)).alias(f"{name}_bound")]
    return per.select(*out)


def newly_proven(before: DataFrame, after: DataFrame) -> DataFrame:
    """[L18] Rules(rule_id, n) that reached ``PROVEN_AT`` observations between two states."""
    from corvid.operators.findings import PROVEN_AT

    was = before.filter(F.col("n") >= PROVEN_AT).select("rule_id")
    return after.filter(F.col("n") >= PROVEN_AT).join(was, "rule_id", "left_anti").select("rule_id").orderBy("rule_id")


def grade(score: Column) -> Column:
    """[L13] A to E."""
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("E")


def maintainability(df: DataFrame, unit: str = "component") -> DataFrame:
    """[L13, X9] Score, grade and reasons of modules or components.

    Columns: largest, lines, tested (boolean), tested_share (null: judged by ``tested``), commits,
    recent, files, failures, fan_out, in_cycle, duplicates, schema (boolean; test and churn don't count).
    """
    module = unit == "module"
    c, flag = F.col, lambda name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    commits = c("commits") if "commits" in df.columns else F.lit(0)
    churn = c("recent") / F.greatest(c("files"), F.lit(1))
    high = (c("recent") >= 8) | (commits >= 30) if module else (c("recent") >= 12) & (churn >= 1.0)
    often = (c("recent") >= 4) | (commits >= 15) if module else (c("recent") >= 6) & (churn >= 0.5)
    untested = F.when(c("tested_share").isNull(), F.when(flag("tested"), 0).otherwise(20)).when(c("tested_share") == 0, 20).when(c("tested_share") < 0.5, 10).otherwise(0)
    limit = 12 if module else 8
    number = lambda name: c(name).cast("long").cast("string")
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    largest = said("very large file (", number("largest"), " lines)"), said("large file (", number("largest"), " lines)")
    if not module:
        largest = (said("largest file is ", number("largest"), " lines"),) * 2
    changes = said(" (", commits.cast("long").cast("string"), " commits, ", number("recent"), " in the last 90 days)")
    fan = said("depends on ", number("fan_out"), " modules" if module else " components")
    alone = c("tested_share").isNull()
    parts = [
        F.when(c("largest") > 800, F.struct(F.lit(25), largest[0])).when(c("largest") > 400, F.struct(F.lit(12), largest[1])),
        F.when(F.lit(not module) & (c("lines") > 4000), F.struct(F.lit(8), said(number("lines"), " lines in total"))),
        F.when(flag("schema") | (untested == 0), None).when(alone, F.struct(untested, F.lit("no test exercises it"))).when(untested == 20, F.struct(untested, F.lit("no test exercises any of its files"))).otherwise(F.struct(untested, said("tests reach only ", F.bround(c("tested_share") * 100).cast("long").cast("string"), "% of its files"))),
        F.when(flag("schema"), None).when(high, F.struct(F.lit(12), said("high churn", changes))).when(often, F.struct(F.lit(6), said("frequent changes", changes))),
        F.when(c("failures") > 0, F.struct(F.least(F.lit(20), 10 * c("failures")).cast("int"), said(number("failures"), " recorded failure(s)"))),
        F.when(c("fan_out") > 2 * limit, F.struct(F.lit(12), fan)).when(c("fan_out") > limit, F.struct(F.lit(6), fan)),
        F.when(flag("in_cycle"), F.struct(F.lit(10), F.lit("in a dependency cycle"))),
        F.when(c("duplicates") > 0, F.struct(F.lit(8), F.lit("has a duplication suspect"))),
    ]
    found = F.array_compact(F.array(*[p.cast("struct<cost:int,reason:string>") for p in parts]))
    rows = df.withColumn("found", found).withColumn("score", F.greatest(F.lit(0), F.aggregate("found", F.lit(100), lambda left, x: left - x["cost"])))
    return rows.withColumn("grade", grade(F.col("score"))).withColumn("reasons", F.col("found.reason")).drop("found")
