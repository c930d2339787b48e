"""Declared infrastructure as a table: plans over sources, children folded into their parents, and rules of three values.

A resource is a row of ``RESOURCE``: ``seq`` is its place in the reading order and tells it from all others;
``properties`` is a VARIANT; ``unknown`` names property paths that a plan leaves open; ``module``,
``config_address``, ``idx`` and ``refs`` (addresses that its configuration refers to) come from a plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.documents import at_path, document_text, is_truthy, items_of, string_values, text_of
from corvid.functions.scalars import is_unknown, lookup
from corvid.operators.rules import TEST_MATERIAL

RESOURCE = "seq long, repo_id string, address string, native string, kind string, provider string, source string, path string, start_line int, properties variant, unknown array<string>, module string, config_address string, idx string, refs array<string>"
#: Sources whose values are resolved.
PLANNED = ("plan", "state")

# --- plan over source, children into parents -----------------------------------------------------------


def base_address(address: Column) -> Column:
    """[J16] The address in the source: without modules before it and without indexes."""
    bare = F.regexp_replace(F.regexp_replace(address, r"^(?:module\.[^.]*\.)+", ""), r"\[[^\]]*\]$", "")
    parts = F.transform(F.split(bare, r"\."), lambda x: F.regexp_replace(x, r"\[[^\]]*\]$", ""))
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(bare)


def plan_over_source(resources: DataFrame) -> DataFrame:
    """[J16] Planned resources keep their values and get the place of the source that declares them; such sources go."""
    planned = F.col("source").isin(*PLANNED)
    base = resources.filter(planned).select("repo_id", base_address(F.col("address")).alias("address")).distinct()
    literal = resources.filter("source = 'hcl'")
    first = literal.join(base, ["repo_id", "address"], "left_semi").groupBy("repo_id", "address").agg(F.min_by(F.struct("path", "start_line"), "seq").alias("place"))
    moved = resources.filter(planned).withColumn("base", base_address(F.col("address"))).join(first.select("repo_id", F.col("address").alias("base"), "place"), ["repo_id", "base"], "left")
    # The source's place counts even where its line isn't known.
    moved = moved.withColumns({"path": F.when(F.col("place").isNotNull(), F.col("place.path")).otherwise(F.col("path")), "start_line": F.when(F.col("place").isNotNull(), F.col("place.start_line")).otherwise(F.col("start_line"))}).select(resources.columns)
    rest = literal.join(base, ["repo_id", "address"], "left_anti").select(resources.columns)
    return moved.unionByName(rest).unionByName(resources.filter(~planned & (F.col("source") != "hcl")))


@dataclass(frozen=True)
class ChildRule:
    """How resources of one native type configure their parent.

    ``under``: all of the child's properties become the parent's ``key``; ``promote``: the child's ``keys``
    become the parent's; ``append``: the properties are added to the parent's list ``ingress`` or ``egress``,
    by the child's ``type``.  Only ``append`` changes what the parent has already.
    """

    child: str
    parent: str
    mode: str
    key: str = ""
    keys: tuple[str, ...] = ()


def parents_of(resources: DataFrame, rules: list[ChildRule]) -> DataFrame:
    """[J15] (child, place, parent): the seq of each child and of the parent that each of its rules finds, by the rule's place.

    A planned child names its parent in ``refs``, the first that exists: the instance of its own index, else the one without an index.
    Others name it in any of their texts, and of several the least address counts.  Of resources with one address the last counts.
    """
    spark = resources.sparkSession
    table = spark.createDataFrame([(i, r.child, f"{r.parent}.") for i, r in enumerate(rules)], "place int, native string, prefix string")
    children = resources.join(F.broadcast(table), "native")  # the rules: a few rows
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(string_values("properties"), lambda v: F.regexp_extract_all(v, F.lit(r"\b([a-z][a-z0-9_]*\.[A-Za-z0-9_-]+)(?:\.[A-Za-z0-9_]+)*\b"), 1)))))
    planned = F.col("source").isin(*PLANNED)
    all_refs = F.when(planned, F.coalesce("refs", F.array().cast("array<string>"))).otherwise(named)
    refs = children.select("seq", "place", "repo_id", "module", "idx", planned.alias("planned"), F.posexplode(F.filter(all_refs, lambda r: F.startswith(r, F.col("prefix")))).alias("pos", "ref"))
    exact = F.when(F.col("planned"), F.array_distinct(F.array(F.coalesce("idx", F.lit("")), F.lit("")))).otherwise(F.array(F.lit("")))
    wanted = refs.select("seq", "place", "repo_id", "pos", "ref", "planned", F.when(F.col("planned"), F.coalesce("module", F.lit(""))).otherwise("").alias("module"), F.posexplode(exact).alias("second", "idx"))
    address = resources.select("repo_id", F.lit(False).alias("planned"), F.lit("").alias("module"), F.col("address").alias("ref"), F.lit("").alias("idx"), "seq")
    instance = resources.filter(planned).select("repo_id", F.lit(True).alias("planned"), F.coalesce("module", F.lit("")).alias("module"), F.col("config_address").alias("ref"), F.coalesce("idx", F.lit("")).alias("idx"), "seq")
    keys = ["repo_id", "planned", "module", "ref", "idx"]
    there = address.unionByName(instance).groupBy(*keys).agg(F.max("seq").alias("parent"))
    return wanted.join(there, keys).groupBy(F.col("seq").alias("child"), "place").agg(F.min_by("parent", F.struct("pos", "second")).alias("parent"))


def fold_children(resources: DataFrame, rules: list[ChildRule]) -> DataFrame:
    """[J15] ``resources`` with the settings of children in their parents' properties; children stay.

    What is set if absent comes from the first child in reading order and is found by a partial aggregate,
    so a parent of any number of children needs no task of its own; only the list that ``append`` makes is
    as long as its children.  Children take part with their own properties: a fold is one level deep.
    """
    links = parents_of(resources, rules).join(resources.select(F.col("seq").alias("child"), "properties"), "child")
    kind = lambda mode: F.col("place").isin([i for i, r in enumerate(rules) if r.mode == mode])
    own = F.try_variant_get("properties", "$", "map<string,variant>")
    put = links.filter(kind("under")).select("parent", "child", "place", lookup(F.col("place"), {i: r.key for i, r in enumerate(rules)}).alias("key"), F.col("properties").alias("value"), F.lit(0).alias("nth"))
    for i, r in enumerate(rules):
        if r.mode == "promote":
            each = F.posexplode(F.filter(F.array(*[F.lit(k) for k in r.keys]), lambda k: F.map_contains_key(F.col("own"), k)))
            mine = links.filter(F.col("place") == i).withColumn("own", own).select("parent", "child", "place", "own", each.alias("nth", "key"))
            put = put.unionByName(mine.select("parent", "child", "place", "key", F.element_at("own", F.col("key")).alias("value"), "nth"))
    first = put.groupBy("parent", "key").agg(F.min_by("value", F.struct("child", "place", "nth")).alias("value"))
    given = first.groupBy("parent").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("given"))  # as many keys as the rules name
    way = F.when(F.lower(F.coalesce(text_of(at_path(F.col("properties"), "type", exact=True)), F.lit(""))) == "ingress", "ingress").otherwise("egress")
    added = links.filter(kind("append")).select("parent", way.alias("way"), F.struct("child", "place", "properties").alias("entry"))
    ordered = lambda w: F.transform(F.array_sort(F.collect_list(F.when(F.col("way") == w, F.col("entry"))), lambda a, b: F.when(F.struct(a["child"], a["place"]) < F.struct(b["child"], b["place"]), -1).otherwise(1)), lambda e: e["properties"])
    lists = added.groupBy("parent").agg(ordered("ingress").alias("ingress"), ordered("egress").alias("egress"))
    folded = resources.join(given.join(lists, "parent", "full_outer").withColumnRenamed("parent", "seq"), "seq", "left")
    have = F.coalesce(own, F.create_map().cast("map<string,variant>"))
    whole = F.map_concat(F.map_filter(F.coalesce("given", F.create_map().cast("map<string,variant>")), lambda k, _: ~F.map_contains_key(have, k)), have)

    def with_list(m: Column, way: str) -> Column:
        more, old = F.coalesce(F.col(way), F.array().cast("array<variant>")), F.try_element_at(m, F.lit(way))
        kept = F.when(old.isNull() | F.is_variant_null(old), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(old, "$", "array<variant>"), F.array(old)))
        is_list = F.try_variant_get(old, "$", "array<variant>").isNotNull()
        new = F.when((F.size(kept) + F.size(more) == 1) & ~is_list, F.get(F.concat(kept, more), F.lit(0))).otherwise(F.to_variant_object(F.concat(kept, more)))
        return F.when(F.size(more) == 0, m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != way), F.create_map(F.lit(way), new)))

    touched = F.coalesce(F.col("given").isNotNull() | F.col("ingress").isNotNull(), F.lit(False))
    return folded.withColumn("properties", F.when(touched, F.to_variant_object(with_list(with_list(whole, "ingress"), "egress"))).otherwise(F.col("properties"))).select(resources.columns)


# --- rules -----------------------------------------------------------------------------------------------

# Properties whose value names something, so that being there is the evidence, and values that name nothing.
NAMES_A_KEY = (
    r"(?i)(^|[._])(kms_key_id|kms_key_arn|kms_key_name|kms_key_self_link|kms_master_key_id|key_vault_key_id|encryption_key_name|disk_encryption_set_id|disk_encryption_key|"
    r"customer_managed_key|encryption_settings|default_kms_key_name|encryption_config|server_side_encryption_configuration|bucketencryption)$"
)
NAMES_NOTHING = ["", "none", "null", "nil", "false", "0", "-", "n/a"]
# Where rules of ingress are written, what they may hold, and what stands for every address.
INGRESS_BLOCKS = ["ingress", "Ingress", "SecurityGroupIngress", "ingress_rules"]
INGRESS_READS = [*INGRESS_BLOCKS, "cidr_blocks", "type"]
INGRESS_RANGES = ["cidr_blocks", "CidrIp", "cidr_ipv6", "CidrIpv6", "ipv6_cidr_blocks"]
ANY_ADDRESS = ["0.0.0.0/0", "::/0"]
# Severities of declarations in examples and tests.
DEMO_SEVERITY = {"critical": "medium", "high": "medium", "medium": "low"}


@dataclass(frozen=True)
class ResourceRule:
    """What a rule asks of the resources that it is about; ``check`` is one of ``CHECKS``."""

    id: str
    check: str
    properties: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    natives: tuple[str, ...] = ()
    exclude_natives: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    exclude_providers: tuple[str, ...] = ()
    unless_truthy: tuple[str, ...] = ()
    unless_referenced_by: tuple[str, ...] = ()
    unless_text: tuple[str, ...] = ()
    severity: str = "medium"
    confidence: str = "high"
    dimension: str = "security"
    title: str = ""
    controls: tuple[str, ...] = field(default_factory=tuple)


def _any(parts: list[Column]) -> Column:
    """SQL's OR: true if one is, else null if one is unknown."""
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _or_open(found: Column, names: tuple[str, ...] | list[str]) -> Column:
    """True where found, unknown where one of the properties is left open, else false."""
    return F.when(found, True).when(_any([is_unknown(F.lit(p), F.col("unknown")) for p in names]), F.lit(None).cast("boolean")).otherwise(False)


def _value(path: str) -> Column:
    """The value under a path, from the column that ``_judged`` reads all paths into."""
    return F.try_element_at("at", F.lit(path))


def _points_at_something(name: str) -> Column:
    """An identifier that is there."""
    v = _value(name)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", ~F.lower(F.trim(text)).isin(NAMES_NOTHING)).otherwise(is_truthy(v)), F.lit(False))


def _holds(name: str, values: tuple[str, ...]) -> Column:
    """Whether the property, or an item of it, is one of the values."""
    v = _value(name)
    return F.coalesce(F.exists(items_of(v), lambda x: ~F.is_variant_null(x) & text_of(x).isin(list(values))), F.lit(False))


def open_ingress() -> Column:
    """[R2] Whether a rule of ingress admits every address; egress doesn't count."""
    p = F.col("properties")
    blocks = F.flatten(F.array(*[F.coalesce(items_of(_value(k)), F.array().cast("array<variant>")) for k in INGRESS_BLOCKS]))
    alone = F.endswith(F.col("native"), F.lit("security_group_rule")) & (F.lower(F.coalesce(text_of(_value("type")), F.lit(""))) == "ingress")
    blocks = F.concat(blocks, F.when(alone, F.array(p)).otherwise(F.array().cast("array<variant>")))
    ranges = lambda b: F.flatten(F.array(*[F.coalesce(items_of(F.try_element_at(F.try_variant_get(b, "$", "map<string,variant>"), F.lit(k))), F.array().cast("array<variant>")) for k in INGRESS_RANGES]))
    return F.exists(blocks, lambda b: F.exists(ranges(b), lambda x: F.coalesce(F.trim(text_of(x)).isin(ANY_ADDRESS), F.lit(False))))


def _has_text(values: tuple[str, ...]) -> Column:
    text = document_text("properties")
    return _any([F.contains(text, F.lit(v.lower())) for v in values])


#: What each kind of check asks: a boolean column, null where an open value decides.
CHECKS = {
    "property_truthy": lambda r: _or_open(_any([is_truthy(_value(p)) | (_points_at_something(p) if _names_a_key(p) else F.lit(False)) for p in r.properties]), r.properties),
    "property_absent_or_false": lambda r: ~_or_open(_any([is_truthy(_value(p)) for p in r.properties]), r.properties),
    "property_equals": lambda r: F.when(~_or_open(F.lit(False), r.properties), text_of(_value(r.properties[0])) == r.values[0]),
    "property_not_in": lambda r: ~_or_open(_any([_holds(p, r.values) for p in r.properties]), r.properties),
    "text_absent": lambda r: ~_has_text(r.values),
    "text_present": lambda r: _has_text(r.values),
    "no_open_ingress": lambda r: ~_or_open(open_ingress(), INGRESS_READS),
}


def _names_a_key(name: str) -> bool:
    return bool(re.search(NAMES_A_KEY, name))


def _about(rule: ResourceRule) -> Column:
    """Whether a rule is about a resource."""
    out = F.lit(True)
    for names, column in ((rule.kinds, "kind"), (rule.natives, "native"), (rule.providers, "provider")):
        if names:
            out = out & F.col(column).isin(*names)
    for names, column in ((rule.exclude_natives, "native"), (rule.exclude_providers, "provider")):
        if names:
            out = out & ~F.coalesce(F.col(column), F.lit("")).isin(*names)
    return F.coalesce(out, F.lit(False))


def _satisfied(rule: ResourceRule) -> Column:
    """[R2] The rule as a column: true, false, or null for what can't be told yet.  Exemptions come first."""
    free = [is_truthy(_value(p)) for p in rule.unless_truthy]
    free += [F.array_contains("pointed_by", p) for p in rule.unless_referenced_by]
    free += [_has_text((t,)) for t in rule.unless_text]
    return F.when(_any(free), True).otherwise(CHECKS[rule.check](rule))


def _pointed_at(resources: DataFrame, names: list[str]) -> DataFrame:
    """(seq, pointed_by): the properties through which another resource points at this one, by its address or a ``Ref`` to it."""
    value = lambda p: at_path(F.col("properties"), p)
    target = lambda p: F.coalesce(F.try_variant_get(at_path(value(p), "Ref", exact=True), "$", "string"), F.when(F.schema_of_variant(value(p)) == "STRING", F.try_variant_get(value(p), "$", "string")))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("name"), target(p).alias("address")) for p in names]))
    refs = resources.select(F.col("seq").alias("by"), each.alias("r")).filter("r.address IS NOT NULL").groupBy("r.name", "r.address").agg(F.min("by").alias("lo"), F.max("by").alias("hi"))
    hit = resources.select("seq", "address").join(refs, "address").filter("lo <> seq OR hi <> seq")
    return hit.groupBy("seq").agg(F.collect_set("name").alias("pointed_by"))


def _judged(resources: DataFrame, rules: list[ResourceRule], columns: list[str]) -> DataFrame:
    """The columns with rule and verdict.  All rules are evaluated in one pass over the resources, which reads each property path once; only exemptions by what points at a resource need a join."""
    names = sorted({p for r in rules for p in r.unless_referenced_by})
    rows = resources.join(_pointed_at(resources, names), "seq", "left").withColumn("pointed_by", F.coalesce("pointed_by", F.array().cast("array<string>"))) if names else resources
    paths = sorted({p for r in rules for p in (*r.properties, *r.unless_truthy, *(INGRESS_READS if r.check == "no_open_ingress" else ()))})
    if paths:
        rows = rows.withColumn("at", F.map_from_arrays(F.array(*map(F.lit, paths)), F.array(*[at_path(F.col("properties"), p) for p in paths])))
    told = lambda c: F.when(c.isNull(), "unknown").when(c, "satisfied").otherwise("violated")
    each = F.array(*[F.when(_about(r), F.struct(F.lit(r.id).alias("rule"), told(_satisfied(r)).alias("verdict"))) for r in rules])
    return rows.select(*columns, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(*columns, "x.rule", "x.verdict")


def judge_resources(resources: DataFrame, rules: list[ResourceRule]) -> DataFrame:
    """[R2] (seq, rule, verdict) of every rule on every resource that it is about: satisfied, violated or unknown."""
    return _judged(resources, rules, ["seq"])


def resource_findings(resources: DataFrame, rules: list[ResourceRule]) -> DataFrame:
    """[R2] A finding for each violation, and for each serious rule that can't be told yet one that it is not assessed.

    Declarations in examples and tests are reported less severely.
    """
    of = lambda what, default=None: lookup(F.col("rule"), {r.id: getattr(r, what) for r in rules}, default)
    rows = _judged(resources, rules, ["repo_id", "address", "native", "path", "start_line"]).filter("verdict <> 'satisfied'")
    open_ = F.col("verdict") == "unknown"
    demo = ~open_ & F.coalesce(F.col("path").rlike(TEST_MATERIAL), F.lit(False))
    severity = of("severity")
    title = F.when(open_, F.concat(F.lit("Cannot evaluate: "), of("title"))).otherwise(F.concat(of("title"), F.when(demo, " (example code)").otherwise("")))
    return rows.filter(~open_ | severity.isin("critical", "high")).select(
        F.concat(F.lit("resource."), "rule", F.when(open_, ".not-assessed").otherwise("")).alias("rule_id"),
        title.alias("title"),
        of("dimension").alias("dimension"),
        F.when(open_, "info").when(demo, F.coalesce(lookup(severity, DEMO_SEVERITY), severity)).otherwise(severity).alias("severity"),
        F.when(open_, "high").when(demo, "low").otherwise(of("confidence")).alias("confidence"),
        "repo_id",
        "path",
        "start_line",
        F.col("address").alias("logical"),
        F.concat(F.when(open_, "unknown:").otherwise(""), "native", F.lit(" "), "address").alias("evidence"),
    )


def resource_coverage(resources: DataFrame, rules: list[ResourceRule]) -> DataFrame:
    """[R2] (rule_id, repo_id, path, n): repositories read from source alone, and checks that wait for values."""
    planned, literal = F.col("source").isin(*PLANNED), F.col("source") == "hcl"
    per = resources.groupBy("repo_id").agg(
        F.count_if(planned).alias("planned"), F.count_if(literal).alias("literal"), F.min_by(F.when(literal, F.col("path")), F.when(literal, F.col("seq"))).alias("source_path"), F.min_by(F.when(planned, F.col("path")), F.when(planned, F.col("seq"))).alias("plan_path")
    )
    open_ = _judged(resources, rules, ["address"]).filter("verdict = 'unknown'").groupBy("address").agg(F.count("*").alias("open"))
    waits = resources.select("repo_id", "address").distinct().join(open_, "address").groupBy("repo_id").agg(F.sum("open").alias("n"))
    alone = per.filter("literal > 0 AND planned = 0").select(F.lit("resource.source-is-literal-hcl").alias("rule_id"), "repo_id", F.col("source_path").alias("path"), F.col("literal").alias("n"))
    return alone.unionByName(per.filter("planned > 0").join(waits, "repo_id").select(F.lit("resource.unknown-until-apply").alias("rule_id"), "repo_id", F.col("plan_path").alias("path"), "n"))
