"""Near duplicates by bottom-k sketches from one hash function (operator 13).

A document is the set of its distinct 5-word shingles; two link when their Jaccard similarity is 0.85 or
more.  One hash function gives every shingle a value, and a document keeps its ``KEPT`` = 64 least ones.

1. Inverted lists of retained values bring documents together.  Sets that link share at least ``SHARED``
   = 28 of their 64 retained values, so a document needs to be in the lists of its 37 rarest retained
   values only (rarest by a count sketch of constant size): of two sets of 64 that share 28, one of those is
   common.  Values that one document alone posts are dropped, and lists are divided by the sets' sizes.
2. Union sketches filter: the 64 least values of two sketches together are the sketch of the union, and
   how many of them both have estimates the similarity.  Under ``SHARED`` of 64 a pair is dropped.
3. The rest is confirmed on the full sets, which are made anew from the texts of these documents.

A list of thousands is not joined pair by pair: its members meet its least document first, lists whose
members are all of one component end, and what is left meets in blocks or through pivots, as in
``jaccard_join``.  Exact copies are one point from the start.

What is lost: sets of at most 64 shingles have whole sketches, and everything about them is exact.  For
larger ones with similarity 0.85 the shared values of a union sketch are 54 of 64 on average, and fewer
than 28 with a probability below 1e-12 (Chernoff); every confirmed link is exact.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are kept; a text of
fewer than five words is one shingle; repeated rows are copies, and rows of one id are kept together; a
row with a null id gets the component of its copies (null if none has an id) and is kept if that is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.bits import SHARE, bits_of, share_rows, test_bits
from corvid.llm.common import cut, mix, only, table
from corvid.llm.jaccard_join import LEAST_CELL_BITS, MOST_CELL_BITS, SAME, SKETCH_BITS, _batches, _levels, _Links, _regions, join_regions

WORDS = 5
#: Values that a sketch keeps, and how many of a union sketch two linked sets share at least.
KEPT, SHARED = 64, 28
#: Fills up the sketches of small sets; no shingle's value.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least values of each row's shingles, in order, as an array of KEPT columns."""
    out = np.full((len(size), KEPT), _NONE)
    for k, (at, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
        own = h[at : at + n]
        if n > KEPT:
            own = np.partition(own, KEPT - 1)[:KEPT]
        out[k, : len(own)] = np.sort(own)
    return out


def _documents(docs: DataFrame, seed: int) -> DataFrame:
    """A row (doc_id, n, point, check, bits) for each document, and rows (block, part) of each task's counts of retained values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "point", "check", "bits", "block", "part"]
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for ids, n, a, b, h, first in _batches(batches, seed, WORDS):
            kept = sketches(h, first[: len(n)], n)
            np.add.at(counts, (kept[kept != _NONE] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            bits = [x.tobytes() for x in kept]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        block, part = share_rows(counts)
        null = pa.nulls(len(block), pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.nulls(len(block), pa.binary()), block, part], names=names)

    return docs.mapInArrow(run, f"doc_id long, n long, point long, check long, bits binary, {SHARE}")


def _posted(n: np.ndarray) -> np.ndarray:
    """In how many lists a set of n has to be, so that it meets every set it may link with."""
    return np.where(n <= KEPT * SAME // 100, n - (SAME * n + 99) // 100 + 1, np.minimum(n, KEPT) - SHARED + 1)


def _postings(points: DataFrame, levels: np.ndarray, seed: int, wanted: np.ndarray | None = None, wanted_bits: int = 0) -> DataFrame:
    """(cell, point, n, pos): every point in the lists of its rarest retained values; if ``wanted`` is given, only in those whose bit is set."""
    shared = points.sparkSession.sparkContext.broadcast((levels, wanted))  # 1 MB and 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, wanted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n, point = np.asarray(batch.column("n")), np.asarray(batch.column("point"))
            kept = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(n), KEPT)
            rank = (levels[(kept >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix((kept + np.uint64(seed + 1)).ravel()).reshape(kept.shape) >> np.uint64(6))
            rank[kept == _NONE] = _NONE
            order = np.argsort(rank, axis=1)
            row, place = np.nonzero(np.arange(KEPT)[None, :] < _posted(n)[:, None])
            cell = kept[row, order[row, place]]
            if wanted is not None:
                some = test_bits(wanted, mix(cell.copy()), wanted_bits)
                row, cell = row[some], cell[some]
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(point[row]), pa.array(n[row].astype(np.int32)), pa.array(np.zeros(len(row), np.int32))], names=["cell", "point", "n", "pos"])

    return points.select("point", "n", "bits").mapInArrow(run, "cell long, point long, n int, pos int")


def _likely(shared: np.ndarray, in_union: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m may link, from the retained values that they share and those of them in the union's sketch."""
    exact = (n <= KEPT) & (m <= KEPT)
    return np.where(exact, 100 * shared >= SAME * (n + m - shared), in_union >= SHARED)


def _near_by_sketch(one: np.ndarray, many: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """Which of many sets may link with one, by their sketches (as bytes)."""
    if not len(many):
        return np.zeros(0, bool)
    x, y = one.view(np.uint64), np.ascontiguousarray(many).view(np.uint64)
    at = np.minimum(np.searchsorted(x, y), KEPT - 1)
    hit = (x[at] == y) & (y != _NONE)
    # A shared value's rank in the union: its ranks in both, less the shared values up to it.
    rank = at + np.arange(KEPT)[None, :] + 2 - np.cumsum(hit, axis=1)
    return _likely(hit.sum(axis=1), (hit & (rank <= KEPT)).sum(axis=1), np.full(len(size), n), size)


class _SketchLinks(_Links):
    may = staticmethod(_near_by_sketch)

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose union sketch lets them link."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                both = np.concatenate([np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, KEPT) for c in ("x", "y")], axis=1)
                both.sort(axis=1)
                hit = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
                rank = np.arange(1, 2 * KEPT)[None, :] + 1 - np.cumsum(hit, axis=1)
                may = _likely(hit.sum(axis=1), (hit & (rank <= KEPT)).sum(axis=1), np.asarray(batch.column("m")), np.asarray(batch.column("n")))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(may))

        left, right = (self.bitmaps.select(F.col("point").alias(p), F.col("n").alias(n), F.col("bits").alias(v)) for p, n, v in (("a", "m", "x"), ("b", "n", "y")))
        sized = (F.lit(100) * F.least("m", "n") >= F.lit(SAME) * F.greatest("m", "n")) & (F.col("a") != F.col("b"))
        return pairs.join(left, "a").join(right, "b").filter(sized).select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def _link(docs: DataFrame, rows: DataFrame, seed: int) -> DataFrame | None:
    """(node, label) of the points that have a link."""
    found = rows.filter("block IS NULL AND n > 0")
    points = cut(found.select("point", "n", "bits").dropDuplicates(["point"]))
    levels = _levels(rows)
    held = _postings(points, levels, seed).groupBy("cell").agg(F.min("point").alias("lo"), F.max("point").alias("hi"))
    shared = cut(held.filter("lo <> hi").select("cell"))
    bits = min(MOST_CELL_BITS, max(LEAST_CELL_BITS, (8 * shared.count()).bit_length()))
    members = _postings(points, levels, seed, bits_of(shared, "cell", bits), bits)
    return join_regions(cut(_regions(members, shared)), _SketchLinks(docs, found, points, seed, WORDS))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    docs = only(docs, {"doc_id": "long", "text": "string"})
    for seed in range(8):
        rows = cut(_documents(docs, seed))
        points = rows.filter("block IS NULL").select("doc_id", "n", "point", "check")
        # Two sets under one 64-bit id would be taken for one: then all ids are made anew.
        if points.filter("n > 0").groupBy("point").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").isEmpty():
            break
    labels = _link(docs, rows, seed)
    named = points.join(labels.withColumnRenamed("node", "point"), "point", "left").select("doc_id", "n", F.coalesce("label", "point").alias("label"))
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
