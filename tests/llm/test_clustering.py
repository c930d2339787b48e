"""Centroid clustering against every distance computed, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster string"


def brute(rows, clusters, rounds, size):
    kept = [(i, [math.floor(64 * v) for v in e]) for i, e, *_ in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    at = [x for _, x in seeds]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    if not at:
        return []
    for turn in range(rounds + 1):
        best = [min((far(x, c), k) for k, c in enumerate(at)) for _, x in kept]
        if turn < rounds:
            for k in range(len(at)):
                mine = [x for (_, x), (_, j) in zip(kept, best, strict=True) if j == k]
                if mine:
                    at[k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return sorted(((i, x, k, d) for (i, x), (d, k) in zip(kept, best, strict=True)), key=str)


def found(df, clusters, rounds, size):
    from corvid.llm.centroid_clustering import cluster_vectors

    out = cluster_vectors(df, clusters, rounds, size)
    return sorted(((r["vec_id"], [int(v) for v in r["x"]], r["cluster"], r["distance"]) for r in out.vectors.collect()), key=str), out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 4
    out = [(i, (centre[i % 6] + rng.normal(size=8) * 0.2).tolist(), i % 2, "a", "b") for i in range(300)]
    same = out[7][1]
    out += [(7, same, 0, None, None), (7, same, 0, None, None), (None, same, 0, None, None), (900, None, 0, None, None), (901, same[:7], 0, None, None), (902, [*same[:7], None], 0, None, None)]
    out += [(903, [*same[:7], float("nan")], 0, None, None), (904, [*same[:7], float("inf")], 0, None, None), (905, [-0.001] * 8, 0, None, None), (906, [], 0, None, None)]
    return out


@pytest.mark.parametrize("clusters", [1, 6, 16])
def test_clusters(spark, rows, clusters):
    got, out = found(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters, 4, 8)
    assert got == brute(rows, clusters, 4, 8)
    assert sum(out.inertia.values()) == sum(r[3] for r in got)
    assert out.scans[0] == len(got) and (clusters == 1 or out.scans[-1] < len(got))  # the bounds spare vectors


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0], 0, "", "") for i, x in enumerate([0, 0, 2, 2, 1, 1, 1])]
    assert found(spark.createDataFrame(rows, SCHEMA), 4, 3, 2)[0] == brute(rows, 4, 3, 2)


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.integers(0, 25))).tolist(), 0, "", "") for i in range(60)]
    want = [(i, x, k, d if d < 1 << 63 else None) for i, x, k, d in brute(rows, 5, 3, 3)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(2), 5, 3, 3)[0] == sorted(want, key=str)


def test_few_and_no_vectors(spark):
    two = [(1, [1.0, 2.0], 0, "", ""), (2, [3.0, 4.0], 0, "", "")]
    assert found(spark.createDataFrame(two, SCHEMA), 16, 3, 2)[0] == brute(two, 16, 3, 2)
    assert found(spark.createDataFrame([], SCHEMA), 16, 3, 2)[0] == []
    assert found(spark.createDataFrame([(None, [1.0, 2.0], 0, "", "")], SCHEMA), 16, 3, 2)[0] == []
