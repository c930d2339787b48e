"""Set operations on tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def united(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """[U1] Rows of all tables; of one key the row of the first table that has it."""
    out = None
    for k, df in enumerate(tables):
        part = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("r"), F.lit(k).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.min_by("r", "rank").alias("r")).select(*keys, "r.*")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[U2, R7] Keys that one side has and the other has not, with the side."""
    a, b = (df.select(*keys).distinct() for df in (a, b))
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("b")))


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[U3] Keys that both sides have."""
    return a.select(*keys).intersect(b.select(*keys))


def first_order_distinct(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """[U4] (key, value, order) with each different value of a key once, at its first place."""
    return df.groupBy(key, value).agg(F.min(order).alias(order))


def disagreeing_values(df: DataFrame, name: Column, value: Column, holder: Column) -> DataFrame:
    """[R7] Names that stand for more than one value: name, number of values and of holders."""
    return df.groupBy(name.alias("name")).agg(F.countDistinct(value).alias("values"), F.countDistinct(holder).alias("holders")).filter("values > 1")
