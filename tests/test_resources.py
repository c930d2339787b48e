"""Declared infrastructure on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from corvid.functions.documents import at_path, document_text, is_truthy, text_of
from corvid.operators import resources as rs


def table(spark, rows):
    """Rows from dicts; what isn't given is a literal resource."""
    base = {"repo_id": "r", "native": "bucket", "kind": "object_store", "provider": "aws", "source": "hcl", "path": "main.tf", "start_line": 1, "unknown": [], "module": "", "idx": "", "refs": []}
    names = ["seq", *(c.split()[0] for c in rs.RESOURCE.split(", ")[1:])]
    out = []
    for k, r in enumerate(rows):
        full = base | {"seq": k, "address": f"bucket.b{k}"} | r
        full |= {"properties": json.dumps(full.get("properties", {})), "config_address": full.get("config_address", full["address"])}
        out.append(tuple(full[n] for n in names))
    return spark.createDataFrame(out, rs.RESOURCE.replace("properties variant", "properties string")).withColumn("properties", F.parse_json("properties"))


def test_paths_and_truth(spark):
    doc = {"Storage": {"Encrypted": "On"}, "list": [{"a": 0}, [1]], "none": None, "x.y": 1, "t": True, "f": 0.0, "e": {}, "KEY": 1, "key": 2}
    df = spark.createDataFrame([(json.dumps(doc),)], "d string").withColumn("v", F.parse_json("d"))
    v = F.col("v")
    paths = ["storage.encrypted", "list.0.a", "list.1.0", "list.5", "none", "x.y", "Key", "t", "list.a", ""]
    got = df.select(*[text_of(at_path(v, p)).alias(f"c{i}") for i, p in enumerate(paths)]).first()
    assert list(got) == ["On", "0", "1", "None", "None", "None", "2", "True", "None", "None"]
    truth = df.select(*[is_truthy(at_path(v, p)).alias(f"c{i}") for i, p in enumerate(["storage.encrypted", "list.0.a", "list", "none", "t", "f", "e", "storage", "gone"])]).first()
    assert list(truth) == [True, False, True, False, True, False, False, True, False]
    one = spark.createDataFrame([('{"a":["x, y: z","\\"q\\",b"],"n":{"k":true}}',)], "d string").withColumn("v", F.parse_json("d"))
    assert one.select(document_text("v")).first()[0] == '{"a": ["x, y: z", "\\"q\\",b"], "n": {"k": true}}'


def verdicts(spark, rule, *resources):
    return [r["verdict"] for r in rs.judge_resources(table(spark, resources), [rule]).orderBy("seq").collect()]


def test_rules_have_three_values(spark):
    enc = rs.ResourceRule("e", "property_truthy", ("encrypted", "kms_key_id"))
    props = [{"encrypted": True}, {"encrypted": "false"}, {"kms_key_id": "arn:x"}, {"kms_key_id": " None "}, {"encrypted": "${var.e}"}, {}]
    assert verdicts(spark, enc, *({"properties": p} for p in props), {"unknown": ["encrypted.mode"]}, {"properties": {"encrypted": 1}, "unknown": ["kms_key_id"]}) == ["satisfied", "violated", "satisfied", "violated", "violated", "violated", "unknown", "satisfied"]
    off = rs.ResourceRule("o", "property_absent_or_false", ("public.access",))
    assert verdicts(spark, off, {"properties": {"Public": {"access": "yes"}}, "unknown": ["public"]}, {"unknown": ["public"]}, {}) == ["violated", "unknown", "satisfied"]
    eq = rs.ResourceRule("q", "property_equals", ("tls",), ("True",))
    assert verdicts(spark, eq, {"properties": {"tls": True}}, {"properties": {"tls": "true"}}, {"properties": {"tls": True}, "unknown": ["tls"]}) == ["satisfied", "violated", "unknown"]
    acl = rs.ResourceRule("a", "property_not_in", ("acl", "other"), ("public", "1"), unless_truthy=("block",), unless_text=("Accepted",))
    assert verdicts(spark, acl, {"properties": {"acl": "public"}}, {"properties": {"acl": ["private", 1]}}, {"properties": {"acl": "public", "block": "true"}}, {"properties": {"acl": "public", "why": "ACCEPTED risk"}}, {"unknown": ["other"]}, {"properties": {"acl": None}}) == ["violated", "violated", "satisfied", "satisfied", "unknown", "satisfied"]


def test_open_ingress(spark):
    rule = rs.ResourceRule("i", "no_open_ingress")
    rows = [
        {"properties": {"ingress": [{"cidr_blocks": ["10.0.0.0/8", " ::/0 "]}]}},
        {"properties": {"egress": {"cidr_blocks": "0.0.0.0/0"}}},
        {"properties": {"SecurityGroupIngress": {"CidrIp": "0.0.0.0/0"}}},
        {"properties": {"type": "ingress", "cidr_blocks": ["0.0.0.0/0"]}},
        {"native": "aws_security_group_rule", "properties": {"type": "Ingress", "cidr_blocks": ["0.0.0.0/0"]}},
        {"properties": {"ingress": "0.0.0.0/0"}, "unknown": ["cidr_blocks"]},
        {"properties": {"ingress": []}},
    ]
    assert verdicts(spark, rule, *rows) == ["violated", "satisfied", "violated", "satisfied", "violated", "unknown", "satisfied"]


def test_what_rules_are_about_and_what_points_at_a_resource(spark):
    rule = rs.ResourceRule("l", "property_truthy", ("logging",), kinds=("object_store",), exclude_natives=("other",), exclude_providers=("k8s",), unless_referenced_by=("log.bucket",), severity="high", title="T")
    rows = [{"properties": {"log": {"bucket": "bucket.b1"}}}, {}, {"native": "other"}, {"provider": "k8s"}, {"kind": "database"}, {"properties": {"log": {"bucket": {"Ref": "bucket.b5"}}}}, {"path": "examples/x.tf"}, {"unknown": ["logging"], "source": "plan", "repo_id": "p"}]
    got = {r["seq"]: r["verdict"] for r in rs.judge_resources(table(spark, rows), [rule]).collect()}
    assert got == {0: "violated", 1: "satisfied", 5: "violated", 6: "violated", 7: "unknown"}  # pointing at oneself doesn't count
    found = {(r["rule_id"], r["title"], r["severity"], r["confidence"], r["evidence"]) for r in rs.resource_findings(table(spark, rows), [rule]).filter("path <> 'main.tf' OR repo_id = 'p'").collect()}
    assert found == {("resource.l", "T (example code)", "medium", "low", "bucket bucket.b6"), ("resource.l.not-assessed", "Cannot evaluate: T", "info", "high", "unknown:bucket bucket.b7")}
    assert {tuple(r) for r in rs.resource_coverage(table(spark, rows), [rule]).collect()} == {("resource.source-is-literal-hcl", "r", "main.tf", 7), ("resource.unknown-until-apply", "p", "main.tf", 1)}


RULES = [rs.ChildRule("enc", "bucket", "under", key="enc"), rs.ChildRule("acl", "bucket", "promote", keys=("acl", "owner")), rs.ChildRule("sgr", "sg", "append")]


def folded(spark, rows):
    return {r["address"]: json.loads(r["p"]) for r in rs.fold_children(table(spark, rows), RULES).select("address", F.to_json("properties").alias("p")).collect()}


def test_children_are_folded_in_order(spark):
    rows = [
        {"address": "bucket.a", "properties": {"owner": "me"}},
        {"native": "enc", "address": "enc.second", "seq": 900, "properties": {"bucket": "${bucket.a.id}", "n": 2}},
        {"native": "enc", "address": "enc.first", "seq": 500, "properties": {"deep": [{"x": "see bucket.a.arn"}], "n": 1}},
        {"native": "acl", "address": "acl.a", "properties": {"bucket": "bucket.a", "acl": "public", "owner": "other"}},
        {"native": "acl", "address": "acl.lost", "properties": {"bucket": "bucket.nowhere", "acl": "x"}},
        {"native": "sg", "address": "sg.none", "properties": {}},
        {"native": "sg", "address": "sg.list", "properties": {"ingress": [{"p": 0}], "egress": None}},
        {"native": "sg", "address": "sg.one", "properties": {"ingress": {"p": 0}}},
        *[{"native": "sgr", "address": f"sgr.{t}{k}", "properties": {"sg": f"sg.{t}", "type": w, "p": k}} for k, (t, w) in enumerate([("none", "ingress"), ("list", "INGRESS"), ("one", "ingress"), ("one", "ingress"), ("list", "egress"), ("list", None)], 1)],
    ]
    got = folded(spark, rows)
    assert got["bucket.a"] == {"owner": "me", "acl": "public", "enc": {"deep": [{"x": "see bucket.a.arn"}], "n": 1}}
    entry = lambda t, w, k: {"sg": f"sg.{t}", "type": w, "p": k}
    assert got["sg.none"] == {"ingress": entry("none", "ingress", 1)}
    assert got["sg.list"] == {"ingress": [{"p": 0}, entry("list", "INGRESS", 2)], "egress": [entry("list", "egress", 5), entry("list", None, 6)]}
    assert got["sg.one"] == {"ingress": [{"p": 0}, entry("one", "ingress", 3), entry("one", "ingress", 4)]}
    assert len(got) == len(rows) and got["acl.lost"] == {"bucket": "bucket.nowhere", "acl": "x"}


def test_planned_children_find_the_instance_of_their_index(spark):
    plan = {"source": "plan", "module": "module.m", "config_address": "bucket.a"}
    rows = [plan | {"address": "module.m.bucket.a[0]", "idx": "0"}, plan | {"address": "module.m.bucket.a[1]", "idx": "1"}, plan | {"address": "module.m.bucket.z", "config_address": "bucket.z"}]
    rows += [plan | {"native": "acl", "address": f"c{k}", "config_address": "acl.c", "idx": k, "refs": refs, "properties": {"acl": f"from {k}"}} for k, refs in (("1", ["var.x", "bucket.a"]), ("7", ["bucket.gone", "bucket.a", "bucket.z"]))]
    rows += [{"native": "acl", "address": "literal", "properties": {"b": "bucket.a"}}]
    got = folded(spark, rows)
    assert [got[f"module.m.bucket.{x}"] for x in ("a[0]", "a[1]", "z")] == [{}, {"acl": "from 1"}, {"acl": "from 7"}]


def test_thousands_of_children_of_one_parent(spark):
    rows = [{"native": "sg", "address": "sg.hot"}] + [{"native": "sgr", "address": f"sgr.{k}", "properties": {"sg": "sg.hot", "type": "ingress", "p": k}} for k in range(3000)]
    assert [x["p"] for x in folded(spark, rows)["sg.hot"]["ingress"]] == list(range(3000))


@pytest.mark.parametrize(("address", "base"), [("bucket.a", "bucket.a"), ('module.s["eu"].bucket.d[0]', "bucket.d"), ('module.a.module.b.bucket.x["k"].y', "x.y"), ("single", "single"), ("module.only", "module.only")])
def test_base_address(spark, address, base):
    assert spark.range(1).select(rs.base_address(F.lit(address))).first()[0] == base


def test_plan_over_source(spark):
    rows = [
        {"address": "bucket.a", "path": "a.tf", "start_line": 4}, {"address": "bucket.a", "path": "b.tf", "start_line": 9}, {"address": "bucket.c", "path": "c.tf", "start_line": None},
        {"address": "module.m.bucket.a[0]", "source": "plan", "path": "plan.json"}, {"address": "bucket.n", "source": "state", "path": "plan.json"}, {"address": "Bucket", "source": "cfn", "path": "t.json"}, {"address": "bucket.a", "repo_id": "other", "path": "o.tf"},
    ]
    got = {(r["repo_id"], r["address"], r["source"], r["path"], r["start_line"]) for r in rs.plan_over_source(table(spark, rows)).collect()}
    assert got == {("r", "module.m.bucket.a[0]", "plan", "a.tf", 4), ("r", "bucket.n", "state", "plan.json", 1), ("r", "bucket.c", "hcl", "c.tf", None), ("r", "Bucket", "cfn", "t.json", 1), ("other", "bucket.a", "hcl", "o.tf", 1)}
