"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word contracts: space and \x09-\x0D.
WORD_SEP = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="corvid-checkpoint-"))


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Batches of whole texts are bounded by bytes in this session, so that a task's memory doesn't follow the texts' lengths; a bound of the user's own stays."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: like ``cut``, but columns can be read one by one."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """The named columns, cast to the given types; all others (clashing names included) are left out."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in spec.items()])


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows so that each holds about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text_col))
        sizes = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1 + col.offset)[col.offset :] if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else None
        start = 0
        while start < batch.num_rows:
            end = start + 1
            if sizes is None:
                end = batch.num_rows
            else:
                end = max(end, int(np.searchsorted(sizes, int(sizes[start]) + max_bytes, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the n + 1 offsets; null rows are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


#: Masks that keep the first 0 .. 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer spans are digested one by one.
_LONG_SPAN = 4096


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed into the hash.  The mixing is not linear, so there are no texts
    that collide by their form, as under polynomial hashes modulo 2 ** 64.
    """
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    long = np.flatnonzero(size > _LONG_SPAN)
    left = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at = 0
    while len(left):
        h[left] = mix(h[left] * np.uint64(0x9FB21C651E98DF25) + (eight[start[left] + at] & _FIRST_BYTES[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a run of bytes other than space and \\x09-\\x0D) of the rows laid end to end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~sep[data]
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    # A row's border ends one word and begins another.
    edge = off[(off > 0) & (off < len(data))]
    edge = edge[inside[edge] & inside[edge + 1]]
    begin[edge] = True
    end[edge] = True
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    return s, e, np.searchsorted(off, s, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values of ``h``; shorter by n - 1."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return mix(out)


def delete(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of ours in the shared checkpoint folder; nothing if ``path`` is None."""
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
