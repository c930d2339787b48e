"""Service calls as tables and streams: the rate limit, and counts of audit events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUESTS, WINDOW_S = 120, 3600


def _judge(kept: deque, at: int | None, requests: int, window: int) -> tuple[bool | None, int | None]:
    """Whether a call at ``at`` (microseconds) is accepted, else the seconds to wait; ``kept`` are the accepted calls."""
    if at is None:
        return None, None
    while kept and kept[0] <= at - window:
        kept.popleft()
    if len(kept) < requests:
        kept.append(at)
        return True, None
    return False, (window - (at - kept[0])) // 1_000_000 + 1


def rate_limit(calls: DataFrame, id: str, requests: int = REQUESTS, window_s: int = WINDOW_S) -> DataFrame:
    """[I10] calls(key_id, at, id) with accepted and wait_s: at most ``requests`` accepted calls of a key in a window.

    Refused calls don't count, so a call depends on all before it, and a sliding count would be wrong.
    The calls of a key are read in order as a stream of batches; a task holds ``requests`` times at
    most, however many calls a key has.  A null key is a key of its own; a call without a time is not
    judged (accepted is null).
    """
    calls = calls.select(id, "key_id", "at")
    schema = calls.schema.add("accepted", "boolean").add("wait_s", "long")
    window = window_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = object(), deque()
        for batch in batches:
            said = []
            for k, at in zip(batch.column("key_id").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if k != key:
                    key, kept = k, deque()
                said.append(_judge(kept, at, requests, window))
            extra = [pa.array([a for a, _ in said], pa.bool_()), pa.array([w for _, w in said], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "accepted", "wait_s"])

    return calls.repartition("key_id").sortWithinPartitions("key_id", "at", id).mapInArrow(run, schema)


def rate_limit_stream(calls: DataFrame, id: str, requests: int = REQUESTS, window_s: int = WINDOW_S, late_s: int = 60) -> DataFrame:
    """[I10, Z3] The same over a stream: a key's state is its accepted times.  Calls of one micro-batch are taken in order of time.

    A key leaves the state when its window has passed for the watermark, which follows the latest call by ``late_s``
    seconds; calls at or behind the watermark are left out.
    """
    window = window_s * 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(int(x) for x in state.get[0]) if state.exists else deque()
        part = pd.concat(list(parts)).sort_values(["at", id])
        said = [_judge(kept, int(at), requests, window) for at in part["at"]]
        state.update((list(kept),))
        # Whole milliseconds after the last accepted call has left the window; never before the watermark.
        state.setTimeoutTimestamp(max(-(-(kept[-1] + window) // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({id: part[id].to_numpy(), "key_id": key[0], "accepted": [a for a, _ in said], "wait_s": pd.array([w for _, w in said], "Int64")})

    types = dict(calls.dtypes)
    timed = calls.filter("at IS NOT NULL").withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", f"{late_s} seconds")
    return timed.groupBy("key_id").applyInPandasWithState(run, f"`{id}` {types[id]}, key_id {types['key_id']}, accepted boolean, wait_s long", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def audit_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events(ts, event) per window and kind, for tables and streams; rows later than ``late`` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")
