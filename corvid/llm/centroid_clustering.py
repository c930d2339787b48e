"""Centroid clustering with Hamerly bounds, in exact integers (operator 11).

Every vector carries one upper bound of the distance to its centroid and one lower bound of the distance
to any other.  A pass loosens both by the drift of the centroids since the last pass and keeps a vector's
cluster without looking at its components while the upper bound stays below the lower one, or below half
the distance from its centroid to the nearest other one.  A vector that fails first gets its exact
distance as upper bound; what is still ambiguous is compared with all centroids in exact integers.

A pass reads the table of vectors and bounds once, writes it again with new bounds, and adds one row of
sums for each cluster and task; these are added up cluster by cluster, in two steps, so the driver gets as
many rows as there are clusters.  No row is shuffled.  The earlier table is deleted when the next one is written.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left
out, as are those with a component whose 64-fold is beyond the doubles; repeated rows are vectors of their own; rows with a null id are clustered but never start a
centroid; rows of one id and hash start centroids in the order of their components; with fewer vectors
than clusters there are as many clusters as vectors, with none no rows; components too large for 64-bit
arithmetic are computed with Python's integers, and distances beyond a long are null (as are inertias);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import delete, ensure_checkpoint_dir, table

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Below this all squared distances of 64 components fit a long.
NARROW = 1 << 27
#: Bounds are rounded outwards by this share.
SLACK = 1e-12
_MOST = (1 << 63) - 1
STATE = "vec_id long, x array<double>, cluster int, upper double, lower double, distance long, part int, n long, scans long, sums array<string>"


class Centroids(NamedTuple):
    """Integer centroids, how far each has moved at most since the last pass, and half the distance to its nearest neighbour at least."""

    points: list[list[int]]
    drift: list[float]
    gap: list[float]


def kept_vectors(embeddings: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, x): the vectors that count, their components as floor(64 * component) in whole doubles."""
    rows = embeddings.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.transform(F.col("`embedding`").cast("array<double>"), lambda v: v * SCALE).alias("x"))
    fits = (F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Spark's floor gives a long; what is beyond longs is whole anyway.
    return rows.filter(fits).withColumn("x", F.transform("x", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)))


def _root(square: int) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def _integers(x: np.ndarray, points: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as 64-bit integers, or as Python's where squares could be too large."""
    most = max((abs(v) for p in points for v in p), default=0)
    if most < NARROW and (not x.size or float(np.abs(x).max()) < NARROW):
        return x.astype(np.int64), np.array(points, np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape), np.array(points, object)


def _squares(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    away = x - to
    return (away * away).sum(axis=1)


def _assign(x: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, at: Centroids, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int | None] | None, int]:
    """Cluster, upper and lower bound of each vector, its squared distance in the last pass, and how many were compared with all centroids."""
    whole, centres = _integers(x, at.points)
    n, k = len(x), len(at.points)
    if cluster is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n), np.arange(n)
    else:
        drift, gap = np.array(at.drift), np.array(at.gap)
        most = int(drift.argmax())
        others = np.full(k, drift[most])
        others[most] = np.delete(drift, most).max(initial=0.0)  # the fastest of the others
        cluster, upper, lower = cluster.copy(), (upper + drift[cluster]) * (1 + SLACK), (lower - others[cluster]) * (1 - SLACK)
        floor = np.maximum(lower, gap[cluster])
        open_ = np.flatnonzero(~(upper < floor))
        if len(open_):
            upper[open_] = [_root(int(d)) * (1 + SLACK) for d in _squares(whole[open_], centres[cluster[open_]])]
            open_ = open_[~(upper[open_] < floor[open_])]
    if len(open_):
        every = np.stack([_squares(whole[open_], c) for c in centres], axis=1)
        nearest = every.argmin(axis=1)  # the first of equal ones
        rows = np.arange(len(open_))
        cluster[open_] = nearest
        upper[open_] = [_root(int(d)) * (1 + SLACK) for d in every[rows, nearest]]
        if k > 1:
            every[rows, nearest] = every.max() + 1
            lower[open_] = [_root(int(d)) * (1 - SLACK) for d in every.min(axis=1)]
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, [int(d) for d in _squares(whole, centres[cluster])] if last else None, len(open_)


def _pass(rows: DataFrame, at: Centroids, first: bool, last: bool) -> DataFrame:
    """A row of ``STATE`` for each vector, and one for each cluster that a task has met: its vectors and the sums of their components (last: of their distances)."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        scans = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(n, -1)
            before = (None, None, None) if first else tuple(np.asarray(batch.column(c)) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, distance, looked = _assign(x, *before, at, last)
            scans += looked
            whole, _ = _integers(x, at.points)
            for k in np.unique(cluster).tolist():
                mine = np.flatnonzero(cluster == k)
                sums = [sum(distance[i] for i in mine.tolist())] if last else [int(v) for v in whole[mine].sum(axis=0)]
                have = total.setdefault(k, [0, [0] * len(sums)])
                have[0] += len(mine)
                have[1] = [a + b for a, b in zip(have[1], sums, strict=True)]
            far = pa.nulls(n, pa.int64()) if distance is None else pa.array([d if d <= _MOST else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), far, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], names=names)
        if total:
            keys, m = list(total), len(total)
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(keys, pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([scans] + [0] * (m - 1), pa.int64()), pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))], names=names)

    return rows.mapInArrow(run, STATE)


def _totals(state: DataFrame) -> list[dict]:
    """part, n, scans and sums of each cluster, added up over the tasks in two steps."""

    def add(rows: pa.Table) -> pa.Table:
        sums = [sum(map(int, column)) for column in zip(*rows.column("sums").to_pylist(), strict=True)]
        return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "scans": pa.array([sum(rows.column("scans").to_pylist())], pa.int64()), "sums": pa.array([[str(v) for v in sums]], pa.list_(pa.string()))})

    schema = "part int, n long, scans long, sums array<string>"
    parts = state.filter("part IS NOT NULL").select("part", "n", "scans", "sums").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(61)))
    some = parts.groupBy("part", "salt").applyInArrow(lambda rows: add(rows), schema)
    return [r.asDict() | {"sums": list(map(int, r["sums"]))} for r in some.groupBy("part").applyInArrow(lambda rows: add(rows), schema).collect()]


def first_centroids(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors of the smallest hashes of their ids, in order of these."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return [[int(v) for v in r["x"]] for r in rows]


def _moved(before: list[list[int]], after: list[list[int]]) -> Centroids:
    apart = lambda p, q: _root(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))
    drift = [apart(p, q) * (1 + SLACK) for p, q in zip(before, after, strict=True)]
    gap = [min((apart(p, q) for j, q in enumerate(after) if j != i), default=math.inf) / 2 * (1 - SLACK) for i, p in enumerate(after)]
    return Centroids(after, drift, gap)


class Clustering(NamedTuple):
    """Vectors (vec_id, x, cluster, distance), the final centroids, the inertia of each cluster, and how many vectors each pass compared with all centroids."""

    vectors: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]
    scans: list[int]


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> Clustering:
    spark = embeddings.sparkSession
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/clusters-{uuid.uuid4().hex}"
    kept_vectors(embeddings, size).write.parquet(f"{home}/vectors")
    path, state = f"{home}/vectors", spark.read.schema("vec_id long, x array<double>").parquet(f"{home}/vectors")
    points = first_centroids(state, clusters)
    at = Centroids(points, [0.0] * len(points), [0.0] * len(points))
    scans: list[int] = []
    for turn in range(rounds + 1 if points else 0):
        _pass(state, at, turn == 0, turn == rounds).write.parquet(f"{home}/{turn}")
        delete(spark, path)
        path = f"{home}/{turn}"
        whole = spark.read.schema(STATE).parquet(path)
        state = whole.filter("part IS NULL").select("vec_id", "x", "cluster", "upper", "lower", "distance")
        totals = _totals(whole)
        scans.append(sum(t["scans"] for t in totals))
        if turn < rounds:
            new = list(at.points)
            for t in totals:
                new[t["part"]] = [v // t["n"] for v in t["sums"]]
            at = _moved(at.points, new)
    if not points:  # only vectors without an id, or none: nothing starts a cluster
        return Clustering(state.select("vec_id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), [], {}, scans)
    return Clustering(state.select("vec_id", "x", "cluster", "distance"), at.points, {t["part"]: t["sums"][0] for t in totals}, scans)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    whole = sum(found.inertia.values())
    long = lambda v: v if v <= _MOST else None
    rows = [(k, long(v), long(whole), hashlib.sha256(",".join(map(str, found.centroids[k])).encode()).hexdigest()) for k, v in found.inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return found.vectors.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster")


def _oracle() -> str:
    """The same by unrolled rounds, every vector compared with every centroid."""
    out = f"""
WITH part AS (SELECT row_number() OVER (ORDER BY vec_id, CAST(embedding AS VARCHAR)) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE}),
item AS (SELECT r, vec_id, unnest(range(0, {SIZE})) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM part),
fit AS (SELECT r, vec_id FROM item GROUP BY r, vec_id HAVING count(CASE WHEN isfinite(x) THEN 1 END) = {SIZE}),
q AS (SELECT r, dim, CAST(floor({SCALE} * x) AS BIGINT) AS v FROM item SEMI JOIN fit USING (r)),
seed AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), r) - 1 AS c FROM fit WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}),
c0 AS (SELECT c, dim, v FROM seed JOIN q USING (r)),"""
    for k in range(ROUNDS + 1):
        out += f"""
d{k} AS (SELECT q.r, c{k}.c, sum((q.v - c{k}.v) * (q.v - c{k}.v)) AS d FROM q JOIN c{k} USING (dim) GROUP BY q.r, c{k}.c),
a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),"""
        if k < ROUNDS:
            out += f"""
m{k} AS (SELECT c, dim, sum(v) AS s, count(*) AS n FROM a{k} JOIN q USING (r) GROUP BY c, dim),
c{k + 1} AS (SELECT c, dim, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM c{k} LEFT JOIN m{k} USING (c, dim)),"""
    return (
        out
        + f"""
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS sha FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN fit USING (r) JOIN h USING (c)
"""
    )


ORACLE_SQL = _oracle()
