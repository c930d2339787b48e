"""Conversation repair against a search over all edits, row by row."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

sys.setrecursionlimit(5000)
SCHEMA = "conv_id long, turn long, role string, text string, c string, part int"


def mended(rows):
    """gaps .. repaired_sha256 of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[ \t-\r]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, made, left):
        """(cost, audit, repaired) of the rest; ``made`` are the last output's initial and whether it is the first."""
        ways = []
        if i == len(rows) and (made == "" or made[0] == "a"):
            ways.append((0, "", ()))
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
        if left:
            ways += [(2 + c, "I" + a, ((x, ""), *r)) for x in ("user", "assistant") if x[0] in ok for c, a, r in [best(i, x[0], left - 1)]]
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, made, 3)
            ways.append((3 + c, "D" + a, r))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if role[:1] and role[:1] in ok:
                    c, a, r = best(i + 1, role[:1], 3)
                    ways.append((more + c, "K" + a, ((role, text), *r)))
                for x in ("user", "assistant"):
                    if x[0] in ok:
                        c, a, r = best(i + 1, x[0], 3)
                        ways.append((2 + more + c, "R" + a, ((x, text), *r)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def expected(rows, damage):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        mine = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(((k, *mended(v)) for k, v in groups.items()), key=str)


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", "s", None, "Über"]
    texts = ["a.", "b!", "c", "", " \t", None, "who?", "é. \n", "d."]
    return [(c, rng.choice([t, t, t, t + 3, None]), rng.choices(roles, [2, 8, 8, 1, 1, 1, 1, 1])[0], rng.choice(texts), "x", 1) for c in range(convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage):
    from corvid.llm.conversation_repair import damaged, repair

    rows = rows_of(3, 150, 9) + [(None, t, "user", "hm.", "x", 1) for t in (0, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, repair(damaged(df) if damage else df).collect()), key=str)
    want = expected(rows, damage)
    if damage:  # conversations without rows after damage are the query's
        want = [w for w in want if w[1:] != (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) or w[0] in {g[0] for g in got}]
    assert got == want


def test_long_conversations_lie_in_several_tasks(spark, monkeypatch):
    from corvid.llm import conversation_repair as c

    monkeypatch.setattr(c, "FRAGMENT", 200)
    rows = rows_of(5, 5, 4) + [(77, t, r, x, "x", 1) for t, (_, _, r, x, *_) in enumerate(rows_of(6, 40, 9)[:120] * 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark joins small partitions
    try:
        assert c._sorted(df).filter("c = '77'").select("part").distinct().count() > 1
        assert sorted(map(tuple, c.repair(df).collect()), key=str) == expected(rows, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_keeps_every_conversation(spark, tmp_path):
    from corvid.llm.conversation_repair import op12_conversation_repair

    rows = rows_of(9, 400, 2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, op12_conversation_repair(spark, str(tmp_path)).collect()), key=str) == expected(rows, True)


def test_empty(spark):
    from corvid.llm.conversation_repair import repair

    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_signatures():
    from corvid.llm.conversation_repair import cheapest_edits

    assert cheapest_edits("ei" * 50_000) == (0, "KK" * 50_000)
    assert cheapest_edits("") == (0, "") and cheapest_edits("a") == (3, "D") and cheapest_edits("e") == (2, "KI")
