"""The driver's tables seen as a project: requirements, commits, files, suites, failures and findings with the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.sources.tables import findings, table


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def part_file() -> Column:
    return F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are requirements, orders commits, parts modules (large ones tests), brands directories, suppliers suites, nations failures, regions rules, events findings."""
    t = lambda n: table(spark, sf_dir, n)
    no, text = F.lit(False), F.lit("")
    none = F.lit(None).cast("string")

    def node(df: DataFrame, id: Column, kind: str, name: Column, file: Column = text, date: Column = none, directory: Column = no, test: Column = no) -> DataFrame:
        return df.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file"), date.alias("date"), directory.alias("directory"), test.alias("test"))

    f = findings(spark, sf_dir)
    parts = [
        node(t("customer"), _id("req", "c_custkey"), "requirement", F.col("c_name")),
        node(t("orders"), _id("commit", "o_orderkey"), "commit", _id("Order#", "o_orderkey"), date=F.date_format("o_orderdate", "yyyy-MM-dd")),
        node(t("part"), _id("part", "p_partkey"), "module", F.col("p_name"), part_file(), test=F.col("p_size") >= 45),
        node(t("part").select("p_brand").distinct(), _id("file", "p_brand"), "file", F.col("p_brand"), F.col("p_brand"), directory=F.lit(True)),
        node(t("supplier"), _id("suite", "s_suppkey"), "suite", F.col("s_name")),
        node(t("nation"), _id("failure", "n_nationkey"), "failure", F.col("n_name")),
        node(t("region"), _id("rule", "r_regionkey"), "rule", F.col("r_name")),
        node(f, _id("finding", "seq"), "finding", F.col("title")),
        node(f.select("rule_id").distinct(), _id("finding_rule", "rule_id"), "finding_rule", F.col("rule_id")),
        node(f.select("probe").distinct(), _id("cwe", "probe"), "cwe", F.col("probe")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(source, target, type, provenance) between the nodes."""
    t = lambda n: table(spark, sf_dir, n)

    def edge(df: DataFrame, source: Column, target: Column, kind: str, provenance: str = "EXTRACTED") -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(provenance).alias("provenance"))

    orders, part, f = t("orders"), t("part"), findings(spark, sf_dir)
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    # Edges of orders are made unique at their end only: their lines are dealt out once, by the order.
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    sold = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    test = part.filter("p_size >= 45").select(F.col("p_partkey").alias("l_partkey"))
    chain = orders.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("before IS NOT NULL")
    home = t("nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("file:Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("folder"))
    tested, code = lines.join(test, "l_partkey", "left_semi").select("l_orderkey", F.col("l_partkey").alias("t")), lines.join(test, "l_partkey", "left_anti").select("l_orderkey", F.col("l_partkey").alias("p"))
    digit = F.substring_index("rule_id", ".", -1).cast("int")
    parts = [
        edge(orders, _id("commit", "o_orderkey"), _id("req", "o_custkey"), "delivers"),
        edge(items.select("l_orderkey", "l_partkey").distinct(), _id("commit", "l_orderkey"), _id("part", "l_partkey"), "modifies"),
        edge(chain, _id("commit", "o_orderkey"), _id("commit", "before"), "follows"),
        edge(sold.select("o_custkey", "l_partkey").distinct(), _id("req", "o_custkey"), _id("part", "l_partkey"), "touches", "INFERRED"),
        edge(t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")), _id("req", "c_custkey"), F.col("folder"), "touches"),
        edge(items.select("l_suppkey", "l_partkey").distinct(), _id("suite", "l_suppkey"), _id("part", "l_partkey"), "covers"),
        edge(items.select("l_suppkey", "l_partkey").distinct().join(test, "l_partkey", "left_semi"), _id("suite", "l_suppkey"), _id("part", "l_partkey"), "contains"),
        edge(part, _id("file", "p_brand"), _id("part", "p_partkey"), "contains"),
        edge(tested.join(code, "l_orderkey").select("t", "p").distinct(), _id("part", "t"), _id("part", "p"), "verifies", "INFERRED"),
        edge(t("customer"), _id("failure", "c_nationkey"), _id("req", "c_custkey"), "arose_in"),
        edge(home, _id("failure", "n_nationkey"), F.col("folder"), "affects"),
        edge(home, _id("failure", "n_nationkey"), _id("rule", "n_regionkey"), "prevented_by"),
        edge(f.join(t("events").select(F.col("event_id").alias("seq"), "user_id"), "seq"), _id("finding", "seq"), _id("req", "user_id"), "cites"),
        edge(f.join(part.select(F.col("p_partkey").alias("start_line")), "start_line"), _id("finding", "seq"), _id("part", "start_line"), "flags"),
        edge(f, _id("finding", "seq"), _id("finding_rule", "rule_id"), "violates"),
        edge(f, _id("finding", "seq"), _id("cwe", "probe"), "classified_as"),
        edge(f.select("rule_id", "probe").distinct(), _id("finding_rule", "rule_id"), _id("cwe", "probe"), "classified_as"),
        edge(f.select("rule_id").distinct(), _id("finding_rule", "rule_id"), F.concat(F.lit("req:"), digit.cast("string")), "specified_by"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
