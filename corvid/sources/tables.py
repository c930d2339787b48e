"""The driver's tables seen as the library's inputs: a graph of nodes and edges, and a table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.scalars import fingerprint, lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S1] nodes(id, kind, name, file): six kinds, ids like kind:key."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key, name, file: (F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file"))
    return (
        t("region").select(*node("region", "r_regionkey", F.col("r_name"), F.lit("")))
        .unionByName(t("nation").select(*node("nation", "n_nationkey", F.col("n_name"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")))))
        .unionByName(t("customer").select(*node("customer", "c_custkey", F.col("c_name"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")))))
        .unionByName(t("supplier").select(*node("supplier", "s_suppkey", F.col("s_name"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")))))
        .unionByName(t("orders").select(*node("order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")))))
        .unionByName(t("part").select(*node("part", "p_partkey", F.col("p_name"), F.concat(F.lit("brand/"), F.col("p_brand")))))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S1] edges(source, target, type): foreign keys, and one edge for each order and part or supplier."""
    t = lambda n: table(spark, sf_dir, n)
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    items = t("lineitem")
    return (
        edge(t("nation"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "contains")
        .unionByName(edge(t("customer"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "contains"))
        .unionByName(edge(t("supplier"), ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "contains"))
        .unionByName(edge(t("orders"), ref("customer", "o_custkey"), ref("order", "o_orderkey"), "defines"))
        .unionByName(edge(items, ref("order", "l_orderkey"), ref("part", "l_partkey"), "uses").distinct())
        .unionByName(edge(items, ref("order", "l_orderkey"), ref("supplier", "l_suppkey"), "touches").distinct())
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small graph for order-sensitive walks: the nations and regions, and who supplies whom."""
    t = lambda n: table(spark, sf_dir, n)
    sold = (
        t("lineitem").select("l_orderkey", "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("buyer")), "o_custkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller")), "l_suppkey")
    )
    return sold.groupBy("seller", "buyer").agg(F.count("*").alias("n"))


# How the events stand for findings.
SEVERITY_OF = {"error": "critical", "signup": "high", "purchase": "medium", "click": "low", "view": "info"}
DIMENSION_OF = {"error": "security", "signup": "compliance", "purchase": "quality", "click": "drift", "view": "supply_chain"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: rule from type and property, severity and dimension from type, repository and path from the user."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    out = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit("."), (k % 10).cast("string")).alias("rule_id"),
        F.concat(F.lit("repo"), (user % 5).cast("string")).alias("repo_id"),
        F.concat(F.lit("d"), (user % 7).cast("string"), F.lit("/f"), user.cast("string"), F.lit(".py")).alias("path"),
        k.alias("start_line"),
        lookup(F.col("event_type"), SEVERITY_OF).alias("severity"),
        lookup(F.col("event_type"), DIMENSION_OF).alias("dimension"),
        F.when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "medium").otherwise("low").alias("confidence"),
        F.col("event_type").alias("probe"),
        F.concat(F.lit("Event "), F.col("event_type"), F.lit("  K "), k.cast("string")).alias("title"),
        F.col("ts"),
    )
    return out.withColumn("id", fingerprint(F.col("rule_id"), F.col("repo_id"), F.col("path"), F.lit(""), F.col("title")))
