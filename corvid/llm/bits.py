"""Bit sets of constant size, made on the executors: a filter that lets through all wanted keys and few others."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import mix

BLOCKS = 64
SHARE = "block int, part binary"


def merge_shares(shares: DataFrame, dtype: type, reduce: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """One array from the tasks' shares of its blocks: rows (block, part), ``part`` a compressed array of ``dtype``.

    Shares meet block by block in two steps, so that no task reads those of all tasks; the driver gets
    ``BLOCKS`` rows, whatever the input.
    """

    def join(part: pa.Table) -> pa.Table:
        total = reduce([np.frombuffer(zlib.decompress(x.as_buffer()), dtype) for x in part.column("part")])
        return pa.table({"block": part.column("block").slice(0, 1), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    salted = shares.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    half = salted.groupBy("block", "salt").applyInArrow(lambda x: join(x), SHARE)
    rows = half.groupBy("block").applyInArrow(lambda x: join(x), SHARE).collect()
    parts = {r["block"]: np.frombuffer(zlib.decompress(bytes(r["part"])), dtype) for r in rows}
    empty = np.zeros_like(next(iter(parts.values()))) if parts else np.zeros(0, dtype)
    return np.concatenate([parts.get(k, empty) for k in range(BLOCKS)])


def share_rows(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's blocks that have something, compressed: where a task has few rows, most of it is zeros."""
    part = total.reshape(BLOCKS, -1)
    some = np.flatnonzero(part.any(1))
    return pa.array(some, pa.int32()), pa.array([zlib.compress(part[k].tobytes(), 1) for k in some], pa.binary())


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bits_of(keys: DataFrame, columns: str | list[str], bits: int, key: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """A packed bit set of 2 ** ``bits`` bits.  The long columns are hashed by ``key`` (default: one column, mixed)."""
    columns = [columns] if isinstance(columns, str) else columns
    key = key or (lambda x: mix(x.view(np.uint64).copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = _place(key(*(np.asarray(c) for c in batch.columns)), bits)
            np.bitwise_or.at(have, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays(list(share_rows(have)), names=["block", "part"])

    out = merge_shares(keys.select(*columns).mapInArrow(run, SHARE), np.uint8, np.bitwise_or.reduce)
    return out if len(out) else np.zeros(1 << (bits - 3), np.uint8)


def test_bits(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = _place(h, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
