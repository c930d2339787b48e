"""The streams give what the same functions give over a table."""

import numpy as np

from corvid.streaming import service as sv

SCHEMA = "call long, key_id string, at long"


def test_rate_limit_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[int(rng.integers(3))], (10**9 + int(t)) * 1_000_000) for i, t in enumerate(np.sort(rng.integers(0, 600, 200)))]
    later = (200, "z", (10**9 + 10_000) * 1_000_000)
    for part in (rows[:120], rows[120:], [later]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sv.rate_limit_stream(calls, "call", 4, 60).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = {r["call"]: (r["accepted"], r["wait_s"]) for r in spark.table("judged").collect()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) >= 3 * min(held[-1], 2) and held[-1] < max(held)  # the keys a, b and c have left the state
    rows.append(later)
    kept, want = {}, {}
    for call, key, at in rows:
        recent = [x for x in kept.get(key, []) if x > at - 60_000_000]
        want[call] = (True, None) if len(recent) < 4 else (False, (60_000_000 - (at - min(recent))) // 1_000_000 + 1)
        kept[key] = recent + [at] * want[call][0]
    assert got == want and {a for a, _ in got.values()} == {True, False}
    table = sv.rate_limit(spark.createDataFrame([*rows, (900, None, 5), (901, "a", None)], SCHEMA), "call", 4, 60)
    assert {r["call"]: (r["accepted"], r["wait_s"]) for r in table.collect()} == want | {900: (True, None), 901: (None, None)}
    assert sv.rate_limit(spark.createDataFrame([], SCHEMA), "call").count() == 0


def test_audit_counts_as_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 3, 1)
    rows = [(start + timedelta(minutes=7 * k), "ab"[k % 3 == 0]) for k in range(60)]
    late = (start, "a")  # hours behind what came before it
    schema = "ts timestamp, event string"
    for part in (rows[:30], rows[30:], [late]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sv.audit_counts(events).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = sorted(map(tuple, spark.table("counted").collect()))
    assert got == sorted(map(tuple, sv.audit_counts(spark.createDataFrame([*rows, late], schema)).collect()))
    run = sv.audit_counts(events).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "append")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    closed = sorted(map(tuple, spark.table("closed").collect()))
    assert set(closed) < set(map(tuple, sv.audit_counts(spark.createDataFrame(rows, schema)).collect()))
