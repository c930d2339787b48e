"""The driver's tables seen as declared infrastructure: suppliers are stores, parts configure them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.resources import ChildRule, ResourceRule
from corvid.sources.tables import table

#: Parts of one last digit configure the same store, so a store has as many children as the table has rows for it.
CHILDREN = [
    ChildRule("bucket_encryption", "bucket", "under", key="encryption"),
    ChildRule("bucket_acl", "bucket", "promote", keys=("acl", "owner")),
    ChildRule("bucket_rule", "bucket", "append"),
]
RULES = [
    ResourceRule("not-encrypted", "property_truthy", ("encrypted", "encryption.algo", "kms_key_id"), kinds=("object_store",), exclude_providers=("k8s",), severity="high", title="Store is not encrypted"),
    ResourceRule("public", "property_not_in", ("acl", "ACL"), ("public-read", "public-read-write"), kinds=("object_store",), unless_truthy=("block.public",), severity="critical", title="Store is public"),
    ResourceRule("not-versioned", "property_truthy", ("versioning.enabled",), natives=("bucket",), severity="medium", confidence="medium", dimension="compliance", title="Store keeps no versions"),
    ResourceRule("no-logging", "property_truthy", ("target.none",), kinds=("object_store",), providers=("aws",), unless_referenced_by=("Logging.target",), severity="low", title="Store isn't logged"),
    ResourceRule("open-ingress", "no_open_ingress", kinds=("object_store",), severity="high", title="Ingress from anywhere"),
    ResourceRule("debug", "text_absent", values=("stage: debug", '"tags": ["debug"'), natives=("bucket",), exclude_natives=("bucket_rule",), severity="low", title="Debug settings"),
    ResourceRule("named-tag", "property_equals", ("tags.0",), ("prod",), kinds=("object_store",), unless_text=("exempt",), severity="medium", dimension="quality", title="First tag isn't prod"),
]


def _source(key: Column) -> Column:
    return F.when(key % 4 == 2, "plan").when(key % 4 == 3, "state").otherwise("hcl")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[B17] Rows of ``operators.resources.RESOURCE``."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    key, nation, balance = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    none = F.array().cast("array<string>")
    address = F.concat(F.lit("bucket.s"), key.cast("string"))
    text = F.format_string(
        '{"acl":"%s","Encrypted":%s,"kms_key_id":"%s","Logging":{"target":{"Ref":"bucket.s%s"}},"versioning":{"Enabled":"%s"},"block":{"public":%s},"tags":["%s","n%s"]%s}',
        F.when(balance < 0, "public-read").otherwise("private"),
        F.when(balance > 5000, "true").otherwise("false"),
        F.when(nation % 4 == 0, F.concat(F.lit("key/"), nation.cast("string"))).otherwise("None"),
        (key - key % 3).cast("string"),
        F.when(key % 5 == 0, " Yes ").otherwise("no"),
        F.when(key % 13 == 0, "1").otherwise("0"),
        F.when(key % 6 == 0, "debug").when(key % 6 == 1, "dev").otherwise("prod"),
        nation.cast("string"),
        F.when(key % 9 == 0, ',"note":"EXEMPT, see stage: debug"').otherwise(""),
    )
    stores = s.select(
        (key * 2).alias("seq"),
        F.concat(F.lit("repo"), (key % 5).cast("string")).alias("repo_id"),
        address.alias("address"),
        F.lit("bucket").alias("native"),
        F.lit("object_store").alias("kind"),
        F.when(nation % 3 == 0, "aws").when(nation % 3 == 1, "gcp").otherwise("k8s").alias("provider"),
        _source(key).alias("source"),
        F.concat(F.when(nation % 6 == 0, "examples/n").otherwise("infra/n"), nation.cast("string"), F.lit(".tf")).alias("path"),
        (key % 100).cast("int").alias("start_line"),
        text.alias("text"),
        F.concat(F.when(key % 7 == 0, F.array(F.lit("encrypted"))).otherwise(none), F.when(key % 11 == 0, F.array(F.lit("versioning"))).otherwise(none), F.when(key % 10 == 3, F.array(F.lit("ingress.0"))).otherwise(none)).alias("unknown"),
        F.lit("").alias("module"),
        address.alias("config_address"),
        F.lit("").alias("idx"),
        none.alias("refs"),
    )
    part, parent = F.col("p_partkey"), F.col("p_partkey") % 10
    native = F.when(F.col("p_size") % 3 == 0, "bucket_encryption").when(F.col("p_size") % 3 == 1, "bucket_acl").otherwise("bucket_rule")
    planned = _source(parent) != "hcl"
    ref = F.concat(F.lit("bucket.s"), parent.cast("string"))
    own = F.concat(native, F.lit(".p"), part.cast("string"))
    text = F.format_string(
        '{"bucket":"%s","algo":"a%s","acl":"%s","type":"%s","cidr_blocks":["10.0.0.0/8","%s"],"tag":"p%s"}',
        F.when(planned, "resolved").otherwise(F.concat(F.lit("${"), ref, F.lit(".id}"))),
        F.col("p_size").cast("string"),
        F.when(F.col("p_size") > 25, "public-read").otherwise("private"),
        F.when(part % 3 == 0, "Ingress").otherwise("egress"),
        F.when(F.col("p_size") > 40, " 0.0.0.0/0").otherwise("10.1.0.0/16"),
        part.cast("string"),
    )
    children = p.select(
        (part * 2 + 1).alias("seq"),
        F.concat(F.lit("repo"), (parent % 5).cast("string")).alias("repo_id"),
        own.alias("address"),
        native.alias("native"),
        F.lit("other").alias("kind"),
        F.lit("aws").alias("provider"),
        _source(parent).alias("source"),
        F.lit("infra/parts.tf").alias("path"),
        F.col("p_size").alias("start_line"),
        text.alias("text"),
        none.alias("unknown"),
        F.lit("").alias("module"),
        own.alias("config_address"),
        F.lit("").alias("idx"),
        F.when(planned, F.array(F.lit("other.x"), ref)).otherwise(none).alias("refs"),
    )
    out = stores.unionByName(children).withColumn("properties", F.try_parse_json("text"))
    return out.select("seq", "repo_id", "address", "native", "kind", "provider", "source", "path", "start_line", "properties", "unknown", "module", "config_address", "idx", "refs")
