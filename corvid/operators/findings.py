"""The findings pipeline: dedupe, baseline, suppression, roll-ups, scoring, gates, controls, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalars import SEVERITIES, at_least, file_glob, severity_rank, weight

# Dimension weights of the overall score; others weigh 0.1.
DIMENSION_WEIGHT = {"security": 0.3, "compliance": 0.1, "supply_chain": 0.15, "quality": 0.2, "drift": 0.1, "interface": 0.15, "assurance": 0.0}


def dedupe_ids(findings: DataFrame) -> DataFrame:
    """[U5, first pass] One row for each id: the most severe, the first of those; at the place of the first."""
    rest = [c for c in findings.columns if c not in ("id", "seq")]
    best = findings.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(severity_rank(F.col("severity")), "seq")).alias("r"), F.min("seq").alias("seq"), F.count("*").alias("copies"))
    return best.select("id", "seq", "copies", "r.*")


def merge_sites(findings: DataFrame) -> DataFrame:
    """[U5, second pass] Findings of other probes than the first at a site (repo, path, line, title letters) are merged into it.

    Further findings of the first one's probe stay.  Each merged finding leaves ``also:<probe>`` in the
    tags of the last kept one before it.  Rows without a path or line are at no site and stay.
    """
    site = F.when((F.coalesce("path", F.lit("")) != "") & (F.coalesce("start_line", F.lit(0)) != 0), F.struct("repo_id", "path", "start_line", F.substring(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]", ""), 1, 48).alias("letters")))
    sited = findings.withColumn("site", site)
    # Most sites have one probe only; the others are few rows, which are read in order.
    several = sited.filter("site IS NOT NULL").groupBy("site").agg(F.min_by("probe", "seq").alias("first"), F.min("probe").alias("lo"), F.max("probe").alias("hi")).filter("lo <> hi").select("site", "first")
    none = F.array().cast("array<string>")
    alone = sited.join(several.select("site"), "site", "left_anti").drop("site").withColumn("tags", none)
    rows = sited.join(several, "site").withColumn("kept", F.col("probe") == F.col("first"))
    rows = rows.withColumn("owner", F.max(F.when(F.col("kept"), F.col("seq"))).over(Window.partitionBy("site").orderBy("seq")))
    tags = rows.filter("NOT kept").groupBy("site", F.col("owner").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("also:"), "probe").alias("tag")))).alias("t"))
    kept = rows.filter("kept").join(tags.select("site", "seq", F.col("t.tag").alias("tags")), ["site", "seq"], "left")
    return alone.unionByName(kept.withColumn("tags", F.coalesce("tags", none)).select(*alone.columns))


def baseline_status(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """[J3] status new or existing, by the baseline's ids."""
    known = baseline.select("id").distinct().withColumn("known", F.lit(True))
    return findings.join(known, "id", "left").withColumn("status", F.when(F.col("known"), "existing").otherwise("new")).drop("known")


def baseline_ids(findings: DataFrame) -> DataFrame:
    """[K5] Sorted distinct ids of what is not suppressed."""
    active = findings.filter("suppressed_by IS NULL") if "suppressed_by" in findings.columns else findings
    return active.select("id").distinct().orderBy("id")


def diff_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """[J2, X13] One row per id: new, fixed or persisting, moved and severity_changed; of one id the last row counts."""
    last = lambda df, tag: df.groupBy("id").agg(F.max_by(F.struct("severity", "start_line"), "seq").alias(tag))
    both = last(before, "b").join(last(after, "a"), "id", "full_outer")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").otherwise("persisting")
    same = F.col("b").isNotNull() & F.col("a").isNotNull()
    return both.select("id", state.alias("state"), (same & (F.col("a.start_line") != F.col("b.start_line"))).alias("moved"), (same & (F.col("a.severity") != F.col("b.severity"))).alias("severity_changed"), F.coalesce("a.severity", "b.severity").alias("severity"))


def _first_match(df: DataFrame, rules: list[tuple[int, dict]], position: str) -> DataFrame:
    """The place of the first rule that fits each row, from a small ordered rule list, as one expression."""
    out = F.lit(None).cast("int")
    for k, r in reversed(rules):
        test = F.lit(True)
        if r.get("rule"):
            test &= F.col("rule_id").rlike(file_glob(r["rule"]))
        if r.get("path"):
            test &= F.col("path").rlike(file_glob(r["path"]))
        if r.get("id"):
            test &= F.col("id") == r["id"]
        out = F.when(test, k).otherwise(out)
    return df.withColumn(position, out)


def suppress(findings: DataFrame, rules: list[dict], as_of: str) -> DataFrame:
    """[P10] suppressed_by: place of the first rule (rule and path globs, id) that fits and has not expired."""
    live = [(k, r) for k, r in enumerate(rules) if not r.get("expires") or (len(r["expires"]) == 10 and r["expires"] >= as_of)]
    return _first_match(findings, live, "suppressed_by")


def override_severity(findings: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """[P11] The first pattern that fits the rule names the severity."""
    out = F.col("severity")
    for pattern, severity in reversed(overrides):
        out = F.when(F.col("rule_id").rlike(file_glob(pattern)), severity).otherwise(out)
    return findings.withColumn("severity", out)


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """[A4] Five fixed columns; unknown severities are left out."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def rollup(findings: DataFrame, under: str | None = None, least: str = "info", dimension: str | None = None, cwe: str | None = None, rule: str | None = None) -> DataFrame:
    """[A2] Per directory: findings, files, severities and dimensions; filtered by place, severity, dimension, CWE and rule (glob or part), in order of directories."""
    some = _selected(findings, under, least, dimension, cwe, rule)
    per = some.withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).groupBy("directory")
    dims = [F.count_if(F.col("dimension") == d).alias(d) for d in DIMENSION_WEIGHT] if "dimension" in findings.columns else []
    return per.agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], *dims).orderBy("directory")


def _selected(findings: DataFrame, under: str | None, least: str, dimension: str | None, cwe: str | None, rule: str | None) -> DataFrame:
    some = findings.filter(at_least(F.col("severity"), least))
    if under:
        some = some.filter(F.col("path").startswith(under.rstrip("/") + "/") | (F.col("path") == under))
    if dimension:
        some = some.filter(F.col("dimension") == dimension)
    if cwe:
        some = some.filter(F.array_contains("cwe", cwe))
    if rule:
        some = some.filter(rule_matches(F.col("rule_id"), rule))
    return some


def rule_matches(col: Column, pattern: str) -> Column:
    """[P6] A glob where the pattern has * or ?, else a part of the name; case counts."""
    return col.rlike(file_glob(pattern)) if set("*?[") & set(pattern) else F.contains(col, F.lit(pattern))


def by_cwe(findings: DataFrame) -> DataFrame:
    """[A2] Findings and rules of each CWE of the array ``cwe``."""
    return findings.select(F.explode(F.array_distinct("cwe")).alias("cwe"), "rule_id").groupBy("cwe").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


def rule_report(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """[A3] Counts for every rule, also those without a finding, with severities."""
    per = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return rules.join(per, "rule_id", "left").fillna(0, ["n", "files", *SEVERITIES])


def scorecard(findings: DataFrame, probes: DataFrame, loc: int) -> DataFrame:
    """[A7, X5] Per dimension: checks, coverage, penalty and score.

    ``probes`` has name, status, applicable, checks and dimensions (array).  Suppressed findings don't count.
    """
    by = probes.filter("applicable").select(F.explode("dimensions").alias("dimension"), F.greatest(F.lit(1), "checks").alias("checks"), "status").groupBy("dimension").agg(F.sum("checks").alias("applicable"), F.sum(F.when(F.col("status") == "ran", F.col("checks")).otherwise(0)).alias("run"))
    active = findings.filter("suppressed_by IS NULL") if "suppressed_by" in findings.columns else findings
    penalty = active.groupBy("dimension").agg(F.sum(weight(F.col("severity"), F.col("confidence"))).alias("penalty"), F.count("*").alias("findings"))
    size = max(1.0, (max(loc, 1) / 2000) ** 0.5)
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.least(F.lit(100.0), F.coalesce("penalty", F.lit(0.0)) / size))
    return by.join(penalty, "dimension", "left").select("dimension", "applicable", "run", F.coalesce("findings", F.lit(0)).alias("findings"), F.round(score, 1).alias("score"), F.round(F.least(F.lit(1.0), F.col("run") / F.col("applicable")), 3).alias("coverage"))


def overall(card: DataFrame, threshold: float = 0.6) -> DataFrame:
    """[A7] Weighted mean of the scores; withheld (null) below the coverage threshold."""
    w = F.lit(0.1)
    for d, x in DIMENSION_WEIGHT.items():
        w = F.when(F.col("dimension") == d, x).otherwise(w)
    total = card.agg((F.sum("run") / F.sum("applicable")).alias("coverage"), (F.sum(F.col("score") * w) / F.sum(w)).alias("mean"))
    shown = F.round("coverage", 3)  # the threshold is read after rounding
    return total.select(shown.alias("coverage"), F.when(shown >= threshold, F.round("mean", 1)).alias("overall"), (shown < threshold).alias("withheld"))


def gate(findings: DataFrame, fail_on: str = "high", most_new: int = 0) -> DataFrame:
    """[A8] One row: numbers behind each reason, and the verdict.  ``findings`` has suppressed_by and status."""
    open_ = findings.filter("suppressed_by IS NULL")
    counts = open_.agg(F.count_if(at_least(F.col("severity"), fail_on)).alias("severe"), F.count_if(F.col("status") == "new").alias("new"), F.count("*").alias("considered"))
    return counts.withColumn("passed", (F.col("severe") == 0) & (F.col("new") <= most_new))


def gate_reasons(findings: DataFrame, card: DataFrame, probes: DataFrame, severity: str | None = "high", new: str | None = None, coverage_below: float | None = None, probe_errors: bool = False, inferred: bool = False) -> DataFrame:
    """[A8] (reason, n) of each rule that fails: severity, new, coverage, probe_errors.  Inferred findings count only if asked; suppressed ones never."""
    considered = findings.filter("suppressed_by IS NULL")
    if not inferred:
        considered = considered.filter("coalesce(provenance, '') <> 'inferred'")
    counts = considered.agg(*[(F.count_if(test & at_least(F.col("severity"), t)) if t else F.lit(0)).cast("long").alias(name) for name, test, t in (("severity", F.lit(True), severity), ("new", F.col("status") == "new", new))])
    parts = [counts.select(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in ("severity", "new")]
    if coverage_below is not None:
        cov = F.round(F.coalesce(F.sum("run") / F.sum("applicable"), F.lit(0.0)), 3)
        parts.append(card.agg(F.when(cov < coverage_below, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("n")).select(F.lit("coverage").alias("reason"), "n"))
    if probe_errors:
        parts.append(probes.agg(F.count_if(F.col("status") == "error").alias("n")).select(F.lit("probe_errors").alias("reason"), "n"))
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def failing_ids(findings: DataFrame, severity: str | None = "high", new: str | None = None, inferred: bool = False) -> DataFrame:
    """[A8] Sorted ids of the findings that fail a gate by severity or as new ones."""
    test = F.lit(False)
    if severity:
        test |= at_least(F.col("severity"), severity)
    if new:
        test |= (F.col("status") == "new") & at_least(F.col("severity"), new)
    some = findings.filter("suppressed_by IS NULL").filter(test)
    return (some if inferred else some.filter("coalesce(provenance, '') <> 'inferred'")).select("id").distinct().orderBy("id")


def control_states(controls: DataFrame, fired: DataFrame, ran: DataFrame) -> DataFrame:
    """[A12, X6] State of each control(control_id, automatable, satisfied_by array): first case that fits.

    ``fired`` has rule_id; ``ran`` has rule_id and applicable, unknown.
    """
    rules = controls.select("control_id", F.explode_outer("satisfied_by").alias("rule_id"))
    seen = rules.join(fired.select("rule_id").distinct().withColumn("fired", F.lit(True)), "rule_id", "left").join(ran.withColumn("ran", F.lit(True)), "rule_id", "left")
    per = seen.groupBy("control_id").agg(
        F.count("rule_id").alias("checks"),
        F.bool_or(F.coalesce("fired", F.lit(False))).alias("violated"),
        F.bool_and(F.coalesce(~F.col("applicable"), F.lit(False))).alias("inapplicable"),
        F.bool_or(F.coalesce("applicable", F.lit(True)) & (F.col("ran").isNull() | F.coalesce("unknown", F.lit(False)))).alias("open"),
    )
    state = (
        F.when(F.col("automatable") == "none", "not_automatable")
        .when(F.col("checks") == 0, "no_coverage")
        .when(F.col("violated"), "violated")
        .when(F.col("inapplicable"), "no_coverage")
        .when(F.col("open"), "not_assessed")
        .otherwise("satisfied")
    )
    return controls.join(per, "control_id").select("control_id", state.alias("state"))


def control_coverage(states: DataFrame, declared: int | None = None) -> DataFrame:
    """[A12] One row: controls of each state, the share assessed of the declared number, and how many are not listed."""
    names = ["satisfied", "violated", "not_assessed", "no_coverage", "not_automatable"]
    counts = states.agg(F.count("*").alias("listed"), *[F.count_if(F.col("state") == n).alias(n) for n in names])
    total = F.lit(declared).cast("long") if declared else F.col("listed")
    return counts.select(*names, F.round(F.when(total > 0, (F.col("satisfied") + F.col("violated")) / total).otherwise(0.0), 4).alias("assessed"), F.greatest(total - F.col("listed"), F.lit(0)).alias("not_listed"))


def abstentions(findings: DataFrame, probes: DataFrame, scope: DataFrame) -> DataFrame:
    """[L10] Names of what did not run and conclude: unread files of a partial scan, probes, and rules that were not assessed.

    ``scope`` is one row (mode, files_read, files_total, basis).
    """
    unread = scope.filter("mode = 'partial'").select(F.concat(F.lit("scan:"), (F.col("files_total") - F.col("files_read")).cast("string"), F.lit(" of "), F.col("files_total").cast("string"), F.lit(" file(s) not read ("), "basis", F.lit(")")).alias("name"))
    probe = probes.filter("status <> 'ran' AND applicable").select(F.concat(F.lit("probe:"), "name").alias("name"))
    place = F.coalesce(F.nullif(F.col("logical"), F.lit("")), F.col("path"))
    check = findings.filter(F.col("rule_id").endswith(NOT_ASSESSED)).select(F.concat(F.lit("check:"), F.regexp_replace("rule_id", r"\.not-assessed$", ""), F.lit("@"), place).alias("name"))
    return unread.union(probe).union(check).distinct()


NOT_ASSESSED = ".not-assessed"
# Parts of a reason that says a probe was kept from running.
PREVENTED = ["missing binary", "missing python package", "not installed", "forbids", "not selected", "disabled in configuration", "partial scan"]


def claims(findings: DataFrame, probes: DataFrame, card: DataFrame, scope: DataFrame, gate_passed: bool | None, threshold: float = 0.6) -> DataFrame:
    """[L10] (claim, kind, scope, abstained): what a report asserts, and how many things it did not look at.

    Claims: the gate, the grade, every dimension, every probe without a finding, and the coverage.
    """
    missing = abstentions(findings, probes, scope).agg(F.count("*").alias("abstained"))
    partial = scope.agg(F.coalesce(F.bool_or(F.col("mode") == "partial"), F.lit(False)).alias("partial"))
    state = missing.crossJoin(partial).crossJoin(overall(card, threshold))  # three rows of one
    word = lambda test: F.when(test, "complete").otherwise("partial")
    parts = []
    if gate_passed is not None:
        n = F.when(F.lit(gate_passed), F.col("abstained")).otherwise(0)
        parts.append(state.select(F.lit("gate").alias("claim"), F.lit("gate").alias("kind"), (word(F.col("abstained") == 0) if gate_passed else F.lit("complete")).alias("scope"), n.cast("long").alias("abstained")))
    parts.append(state.select(F.lit("grade").alias("claim"), F.lit("grade").alias("kind"), F.when(F.col("overall").isNull(), "withheld").otherwise(word(F.col("coverage") >= 1)).alias("scope"), "abstained"))
    unrun = probes.filter("status <> 'ran' AND applicable").select(F.explode("dimensions").alias("dimension"), "name").distinct().groupBy("dimension").agg(F.count("*").alias("unrun"))
    n = F.coalesce("unrun", F.lit(0)) + F.col("partial").cast("long")
    parts.append(card.join(unrun, "dimension", "left").crossJoin(F.broadcast(partial)).select(F.concat(F.lit("dimension:"), "dimension").alias("claim"), F.lit("dimension").alias("kind"), word((F.col("coverage") >= 1) & (n == 0)).alias("scope"), n.alias("abstained")))
    parts.append(probes.filter("status = 'ran' AND finding_count = 0").crossJoin(F.broadcast(partial)).select(F.concat(F.lit("probe_clean:"), "name").alias("claim"), F.lit("probe_clean").alias("kind"), word(~F.col("partial")).alias("scope"), F.col("partial").cast("long").alias("abstained")))
    parts.append(state.select(F.lit("coverage").alias("claim"), F.lit("coverage").alias("kind"), F.lit("complete").alias("scope"), F.lit(0).cast("long").alias("abstained")))
    return reduce(DataFrame.unionByName, parts)


def claim_violations(probes: DataFrame, card: DataFrame, claims: DataFrame | None = None, totals: DataFrame | None = None, findings: DataFrame | None = None, listed: DataFrame | None = None, partial: bool = False, gate_passed: bool | None = None, threshold: float = 0.6) -> DataFrame:
    """[L11, X7] (invariant, subject) where a report asserts more than it verified; CI-1 to CI-12.

    Without ``claims`` (claim, kind, scope, abstained), ``totals`` (one row: coverage, overall, withheld),
    ``findings`` (rule_id, logical, path, suppressed_by) and ``listed`` (the report's abstentions) only
    the invariants over probes and dimensions are checked.
    """

    def violation(df: DataFrame, name: str, test: str | Column, subject: str) -> DataFrame:
        return df.filter(test).select(F.lit(name).alias("invariant"), F.col(subject).alias("subject"))

    prevented = reduce(Column.__or__, [F.contains(F.lower(F.coalesce("reason", F.lit(""))), F.lit(x)) for x in PREVENTED])
    made = [
        violation(probes, "CI-4", "status <> 'ran' AND trim(coalesce(reason, '')) = ''", "name"),
        violation(card, "CI-5", "coverage >= 1.0 AND run < applicable", "dimension"),
        violation(probes, "CI-7", "status = 'error' AND finding_count > 0", "name"),
        violation(card, "CI-9", "coverage < 0 OR coverage > 1", "dimension"),
        violation(probes, "CI-12", F.expr("NOT applicable") & (F.col("status").isin("ran", "error") | prevented), "name"),
    ]
    if claims is not None:
        full = F.col("scope") == "complete"
        made.append(violation(claims, "CI-1", full & (F.col("abstained") > 0), "claim"))
        unrun = card.filter("run < applicable").select(F.concat(F.lit("dimension:"), "dimension").alias("claim"))
        made.append(violation(claims.filter(full).join(unrun, "claim", "left_semi"), "CI-1", F.lit(True), "claim"))
        if gate_passed and listed is not None:
            some = listed.agg(F.count("*").alias("n")).filter("n > 0")
            made.append(claims.filter(full & (F.col("claim") == "gate")).crossJoin(some).select(F.lit("CI-10").alias("invariant"), F.col("claim").alias("subject")))  # one row each
        if partial:
            exempt = (F.col("kind") == "coverage") | ((F.col("kind") == "gate") & F.lit(gate_passed is False))
            made.append(violation(claims, "CI-11", full & ~exempt, "claim"))
    if totals is not None:
        made.append(violation(totals.withColumn("subject", F.lit("grade")), "CI-2", (F.col("coverage") < threshold) & F.col("overall").isNotNull(), "subject"))
        made.append(violation(totals.withColumn("subject", F.lit("grade")), "CI-3", "withheld AND overall IS NOT NULL", "subject"))
        made.append(violation(totals.withColumn("subject", F.lit("coverage")), "CI-9", "coverage < 0 OR coverage > 1", "subject"))
    if findings is not None:
        hidden = findings.agg(F.count_if(F.col("suppressed_by").isNotNull()).alias("hidden"))
        sums = card.agg(F.sum("run").alias("run"), F.sum("applicable").alias("applicable")).crossJoin(hidden)  # one row each
        made.append(violation(sums.withColumn("subject", F.lit("coverage")), "CI-6", "hidden > 0 AND applicable > 0 AND run > applicable", "subject"))
        if listed is not None:
            place = F.coalesce(F.nullif(F.col("logical"), F.lit("")), F.col("path"))
            checks = findings.filter(F.col("rule_id").endswith(NOT_ASSESSED)).select(F.concat(F.lit("check:"), F.regexp_replace("rule_id", r"\.not-assessed$", ""), F.lit("@"), place).alias("name")).distinct()
            made.append(violation(checks.join(listed, "name", "left_anti"), "CI-8", F.lit(True), "name"))
    return reduce(DataFrame.unionByName, made).distinct()


def match_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[J12 first pass, A19] Multiset match: the n-th row of a key on one side meets the n-th on the other; counts per key.

    Only counts are needed, so no row is numbered: the smaller count of a key is matched.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    both = count(a, "na").join(count(b, "nb"), keys, "full_outer").fillna(0, ["na", "nb"])
    return both.select(*keys, F.least("na", "nb").alias("matched"), (F.col("na") - F.least("na", "nb")).alias("only_a"), (F.col("nb") - F.least("na", "nb")).alias("only_b"))


def disagreements(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """[J17, X11] Buckets of (repo, path, family) seen by one or both tools."""
    key = ["repo_id", "path", "family"]
    worst = lambda df, n: df.groupBy(*key).agg(F.min(severity_rank(F.col("severity"))).alias(n))
    both = worst(ours, "a").join(worst(theirs, "b"), key, "full_outer")
    known = ours.select("family").distinct().withColumn("known", F.lit(True))
    bucket = (
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.abs(F.col("a") - F.col("b")) >= 2, "severity_disagreement").otherwise("corroborated"))
        .when(F.col("a").isNotNull(), "contested")
        .when(F.col("known"), "contested")
        .otherwise("coverage_gap")
    )
    return both.join(known, "family", "left").select(*key, bucket.alias("bucket"))


def disagreement_rows(findings: DataFrame) -> DataFrame:
    """[J17, X11] (id, bucket, gap) of each finding with a family: both tools at (repo, path, family), or one alone.

    ``findings`` has id, seq, native (boolean), family, severity and the place; the first row of an id
    counts, suppressed ones and those without a path or family don't.  Where both tools are, a gap of
    two or more severities to the other tool's findings of the same line and family is a disagreement.
    """
    some = findings.filter("coalesce(path, '') <> '' AND coalesce(family, '') <> ''")
    if "suppressed_by" in findings.columns:
        some = some.filter("suppressed_by IS NULL")
    some = some.withColumn("rank", severity_rank(F.col("severity")))
    area, site = ["repo_id", "path", "family"], ["repo_id", "path", "family", "start_line"]
    sides = some.groupBy(*area).agg(F.bool_or("native").alias("ours"), F.bool_or(~F.col("native")).alias("theirs"))
    # The largest gap to the other side is to its least or its greatest rank.
    peers = some.groupBy(*site, (~F.col("native")).alias("native")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    known = some.filter("native").select("family").distinct().withColumn("known", F.lit(True))
    first = some.groupBy("id").agg(F.min_by(F.struct(*site, "native", "rank"), "seq").alias("r")).select("id", "r.*")
    rows = first.join(sides, area).join(peers, [*site, "native"], "left").join(known, "family", "left")
    gap = F.coalesce(F.greatest(F.abs(F.col("rank") - F.col("lo")), F.abs(F.col("rank") - F.col("hi"))), F.lit(0))
    bucket = F.when(F.col("ours") & F.col("theirs"), F.when(gap >= 2, "severity_disagreement").otherwise("corroborated")).when(F.col("native") | F.col("known"), "contested").otherwise("coverage_gap")
    return rows.select("id", bucket.alias("bucket"), F.when(bucket == "severity_disagreement", gap).alias("gap"))


#: Verdicts after which a rule's precision counts as proven.
PROVEN_AT = 20


def review_queue(findings: DataFrame, done: DataFrame, limit: int, observations: DataFrame | None = None, rule: str | None = None) -> DataFrame:
    """[W3] The ``limit`` findings whose verdict says most, with their tier and idx.

    Neither suppressed nor judged findings count.  Inside a rule: the first finding of each file, then
    the second ones, and so on; repositories take turns.  Rules take turns too, those short of
    ``PROVEN_AT`` observations(rule_id, n) first; among them rules with an observation, then larger ones.
    Each window keeps ``limit`` rows a key, which is as many as any rule can give.
    """
    pool = findings.join(done.select("id").distinct(), "id", "left_anti")
    if "suppressed_by" in findings.columns:
        pool = pool.filter("suppressed_by IS NULL")
    if rule:
        pool = pool.filter(F.contains("rule_id", F.lit(rule)))
    seen = F.lit(0).cast("long")
    rules = pool.groupBy("rule_id").agg(F.count("*").alias("size"))
    if observations is not None:
        rules, seen = rules.join(observations.select("rule_id", F.col("n").alias("seen")), "rule_id", "left"), F.coalesce("seen", F.lit(0).cast("long"))
    rules = rules.select("rule_id", "size", (seen >= PROVEN_AT).cast("int").alias("tier"), (seen == 0).cast("int").alias("fresh"))
    nth = lambda df, name, keys, *order: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= limit)
    by_file = nth(pool, "n", ["rule_id", "repo_id", "path"], "start_line", "seq")
    by_repo = nth(by_file, "pos", ["rule_id", "repo_id"], "n", "path", "seq")
    by_rule = nth(by_repo, "idx", ["rule_id"], "pos", "repo_id", "seq")
    return by_rule.join(rules, "rule_id").orderBy("tier", "idx", "fresh", F.desc("size"), "rule_id").limit(limit)
