"""Near duplicates by sketches against every pair of sets."""

import re

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, n int, point string, bits string"


def sets_of(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(low))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets, label = sets_of([t for _, t, *_ in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids) if sets[i] and ids else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def near_copies(seed, groups, copies, words):
    """Groups whose texts lie on both sides of the threshold; all texts share a passage."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    common = [vocabulary[k] for k in rng.integers(0, 500, words // 3)]
    rows = []
    for g in range(groups):
        base = [vocabulary[k] for k in rng.integers(0, 500, words)] + common
        for k in range(copies):
            w = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, max(2, words // 18)))):
                w[at] = f"x{rng.integers(0, 50)}"
            rows.append((1000 * g + k, " ".join(w[: len(w) - int(rng.integers(0, 5))]), 0, "", ""))
    return rows


@pytest.mark.parametrize("words", [9, 40, 75, 300])
def test_near_copies(spark, words):
    from corvid.llm.minhash_dedup import near_duplicates

    rows = near_copies(words, 8, 25, words)
    want = brute(rows)
    assert 8 < sum(kept for *_, kept in want) < len(rows)
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str) == want


def test_large_groups_meet_in_blocks_and_through_pivots(spark, monkeypatch):
    from corvid.llm import jaccard_join as j
    from corvid.llm.minhash_dedup import near_duplicates

    rows = near_copies(1, 3, 110, 90)
    want = brute(rows)
    for small, meeting in ((3, 100), (3, 3)):
        monkeypatch.setattr(j, "SMALL", small)
        monkeypatch.setattr(j, "MEETING", meeting)
        assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == want


def test_defined_cases(spark):
    from corvid.llm.minhash_dedup import near_duplicates

    (_, a, *_), (_, b, *_) = near_copies(3, 2, 1, 60)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two three four"), (7, "ONE\ntwo three four"), (8, a), (8, a), (None, a), (9, b), (None, "alone " * 3), (10, "x" * 900), (11, a * 40)]
    rows = [(d, t, 0, "", "") for d, t in texts]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_union_sketch_counts_what_both_have():
    from corvid.llm.minhash_dedup import KEPT, SHARED, _near_by_sketch, sketches

    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    others = [np.concatenate([a[:k], rng.integers(0, 2**63, 400 - k, dtype=np.uint64)]) for k in range(0, 401, 20)]
    sets = [a, *others]
    size = np.array([len(x) for x in sets])
    kept = sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    got = _near_by_sketch(kept[0].view(np.uint8), kept[1:].view(np.uint8), 400, size[1:])
    for may, other in zip(got, others, strict=True):
        least = sorted({*a.tolist(), *other.tolist()})[:KEPT]
        assert may == (len({*a.tolist()} & {*other.tolist()} & {*least}) >= SHARED)
