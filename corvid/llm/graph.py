"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import cut

#: Up to so many edges (16 bytes each) one task finds the components; more go through star steps.
ONE_TASK = 100_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours (small: the lesser ones, and itself) to the least of them."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if small else edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if small:
        # The lesser neighbours and the node itself now point to the least one.
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges that lead from a greater to a lesser node are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("u").agg((F.sum("out") + F.max("into")).alias("n"))
    return per.agg(F.count(F.when(F.col("n") > 1, 1))).first()[0] == 0


def _least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component: labels go to the lesser end, and by jumps to their own labels, until nothing changes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
    if parts:
        nodes, label = _least_labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "label"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), both longs; the label is the component's least node."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, label long")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = cut(_star(_star(edges, False), True))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
