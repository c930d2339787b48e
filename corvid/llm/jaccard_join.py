"""N-gram Jaccard join in the Jaccard metric space (operator 9).

A document is the set of its distinct 4-word shingles; two link when their Jaccard distance is at
most ``EPS`` = 0.15.  Exact copies are one point (a digest of the set).  The points are divided by
pivots, region by region, until no region is left that could hold an unknown link:

1. Most documents lie at distance 1 from each other and so from any document that served as a pivot.
   The first pivots are therefore the one-shingle sets: a set of n shingles is at distance 1 - 1/n
   from those of its own shingles and at distance 1 from all others.  A fixed order of the shingles
   (rarest first by a count sketch, then by hash) breaks the tie: its home is its least shingle.  By
   the triangle inequality two points within EPS meet in the region of their first common shingle,
   whose place in the larger set is at most n - 0.85 n and in the smaller one at most n - 170/185 n:
   the larger one is replicated into the regions of that window, the smaller one into those of the
   narrower window.  Regions are divided again by size, as sets within EPS differ in size by 0.85 at
   most.  Regions with a single point end.
2. The least point that holds a region is its first pivot; members within EPS are linked to it, and
   regions whose members are all of one component end.
3. Regions of at most ``SMALL`` points are joined; sizes, places of the shingle and parity bitmaps
   bound each distance from below, and what they leave is measured exactly.
4. Larger ones, as those of one group of near copies, mostly have the same first pivot; the regions of
   one pivot become one.  Up to ``MEETING`` points, those outside the region's largest component meet
   all others block by block.  Regions beyond that get ``PIVOTS`` pivots among the points outside.
   Exact distances make the Voronoi regions of these, each point goes to its nearest pivot and, as a
   guest, to every other whose distance is at most 2 EPS more: two points within EPS meet in both
   homes.  All links of the pivots are known then and they leave.  The parts are joined recursively,
   by steps 3 and 4; where the parts are not much smaller than the whole, as among points that all
   lie within 2 EPS, the blocks of the whole meet.

Linked points form components by large-star and small-star steps.  Shingles and points are told apart
by 64-bit hashes; a second digest finds points that share one, and then all hashes are made anew.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; a text of
fewer than four words is one shingle; repeated rows are copies; rows with a null id take part and
get the component of their copies (null if there is none with an id); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm.bits import SHARE, bits_of, merge_shares, share_rows, test_bits
from corvid.llm.common import cut, lower_ascii, mix, only, pieces, span_hashes, table, text_bytes, window_hashes, words_of, written
from corvid.llm.graph import components

WORDS = 4
#: Two sets link when SAME * union <= 100 * intersection.
SAME = 85
EPS = 0.15
#: Counters of the frequency sketch; bits of the filters of documents and of shared regions (eight a region, in these bounds).
SKETCH_BITS = 20
FILTER_BITS = 24
LEAST_CELL_BITS, MOST_CELL_BITS = 20, 27
#: Bits of a point's parity bitmap (256 bytes).
PARITY_BITS = 2048
#: Regions of at most this many points are joined pair by pair, and those of at most this many block by block; larger ones get pivots.
SMALL, MEETING = 48, 4096
#: Ids of up to this many documents are sent to every executor; more go through a bit set.
SENT_IDS = 200_000
#: Pivots of a larger region, and the bytes of sets that one task holds of each side when blocks meet.
PIVOTS, BLOCK_BYTES = 16, 1 << 20


def shingles(data: np.ndarray, off: np.ndarray, seed: int = 0, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their rows, in order of rows."""
    data = lower_ascii(data)
    s, e, row = words_of(data, off)
    h = span_hashes(data, s, e) + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019)
    hs, rows = [], []
    if len(h) >= words:
        inside = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1])
        hs.append(window_hashes(h, words)[inside])
        rows.append(row[inside])
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    for k in range(1, words):
        which = np.flatnonzero(n == k)
        if len(which):
            hs.append(window_hashes(h, k)[first[which]] + np.uint64(k))
            rows.append(which)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, row = np.concatenate(hs), np.concatenate(rows)
    _, at = np.unique(h ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    at = at[np.argsort(row[at], kind="stable")]
    return h[at], row[at]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def _point_ids(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set, whatever its order."""
    a = _sums(mix(h + np.uint64(0x51ED270B)), first)
    b = _sums(mix(h ^ np.uint64(0xA24BAED4963EE407)), first)
    return a.view(np.int64), b.view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], seed: int, words: int = WORDS):
    """doc_id, n, point digests, shingles and the rows' borders of each piece of the batches."""
    for batch in pieces(batches, "text", 1 << 20):
        data, off = text_bytes(batch.column("text"))
        h, row = shingles(data, off, seed, words)
        first = np.searchsorted(row, np.arange(len(off)))
        yield batch.column("doc_id"), np.diff(first), *_point_ids(h, first), h, first


def _points_and_sketch(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each document, and rows (block, part) of each task's share of the sketch."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "point", "check", "block", "part"]
        counts = np.zeros(size, np.int64)
        for ids, n, a, b, h, _ in _batches(batches, seed):
            np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        block, part = share_rows(counts)
        null = pa.nulls(len(block), pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, null, null, block, part], names=names)

    return docs.mapInArrow(run, f"doc_id long, n long, point long, check long, {SHARE}")


def _levels(rows: DataFrame) -> np.ndarray:
    """How far the count of every bucket stands out (log2), by more than the spread of buckets that only hold rare shingles."""
    counts = merge_shares(rows.filter("block IS NOT NULL").select("block", "part"), np.int64, lambda x: np.sum(x, axis=0))
    if not len(counts):
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    usual = float(np.median(counts))
    return np.log2(np.maximum((counts - usual) / max(1.0, 2 * usual**0.5), 1)).astype(np.uint8)


def _probes(n):
    """How many of its first shingles a set of n may share first with a smaller or equal partner; ``_holds`` for a larger or equal one."""
    return n - (SAME * n + 99) // 100 + 1


def _holds(n: str, pos: str):
    return F.lit(100 + SAME) * (F.col(n) - F.col(pos)) >= F.lit(2 * SAME) * F.col(n)


def _first_shingles(n: np.ndarray, h: np.ndarray, first: np.ndarray, levels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of the shingles whose regions a document may be in, rarest first."""
    rank = (levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(h + np.uint64(seed + 1)) >> np.uint64(6))
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rank, row))
    pos = np.arange(len(h)) - first[row]
    chosen = np.flatnonzero(pos < _probes(n)[row])
    return h[order[chosen]], row[chosen], pos[chosen]


def _cells(docs: DataFrame, levels: np.ndarray, seed: int) -> DataFrame:
    """(cell, point, holds): every document in the regions of its first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, a, _, h, first in _batches(batches, seed):
            cell, r, pos = _first_shingles(n, h, first, shared.value, seed)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(a[r]), pa.array((100 + SAME) * (n[r] - pos) >= 2 * SAME * n[r])], names=["cell", "point", "holds"])

    return docs.mapInArrow(run, "cell long, point long, holds boolean")


def _members(docs: DataFrame, levels: np.ndarray, seed: int, wanted: np.ndarray, wanted_bits: int) -> DataFrame:
    """Rows (cell, point, n, pos) of the regions whose bit is set, and a row (point, n, bits) of every document in one.

    ``bits`` is a parity bitmap of the document's shingles: two sets differ in at least as many shingles
    as their bitmaps in bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast((levels, wanted))  # 1 MB and 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "point", "n", "pos", "bits"]
        for _, n, a, _, h, first in _batches(batches, seed):
            levels, wanted = shared.value
            cell, r, pos = _first_shingles(n, h, first, levels, seed)
            keep = np.flatnonzero(test_bits(wanted, mix(cell.copy()), wanted_bits))
            r = r[keep]
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep].view(np.int64)), pa.array(a[r]), pa.array(n[r].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.nulls(len(r), pa.binary())], names=names)
            pick = np.unique(r)
            place = (mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
            bits = [np.packbits(np.bincount(place[first[k] : first[k + 1]], minlength=PARITY_BITS) & 1).tobytes() for k in pick.tolist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pick), pa.int64()), pa.array(a[pick]), pa.array(n[pick].astype(np.int32)), pa.nulls(len(pick), pa.int32()), pa.array(bits, pa.binary())], names=names)

    return docs.mapInArrow(run, "cell long, point long, n int, pos int, bits binary")


def _sets(docs: DataFrame, ids: np.ndarray | None, seed: int, words: int = WORDS) -> DataFrame:
    """(point, items): the sorted shingles of the documents, of those only whose id's bit is set, or that have no id, if ``ids`` are given."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield batch
                continue
            col = batch.column("doc_id")
            keys = np.asarray(pc.fill_null(col, 0)).astype(np.int64)
            yield batch.filter(pa.array(test_bits(shared.value, mix(keys.view(np.uint64)), FILTER_BITS) | np.asarray(col.is_null())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, a, _, h, first in _batches(some(batches), seed, words):
            pick = np.flatnonzero(n > 0)
            items = [np.sort(h[first[k] : first[k + 1]]).tobytes() for k in pick.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a[pick]), pa.array(items, pa.binary())], names=["point", "items"])

    return docs.mapInArrow(run, "point long, items binary")


def _bounds(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(a, b, least, near): a lower bound of each pair's distance, and whether the pair can still be within EPS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = np.asarray(batch.column("m")) + np.asarray(batch.column("n"))
            # |A| + |B| = total and |A xor B| = differ give the union; SAME * union <= 100 * intersection bounds it.
            near = (100 + SAME) * differ <= (100 - SAME) * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(2 * differ / (total + differ)), pa.array(near)], names=["a", "b", "least", "near"])

    left, right = (bitmaps.select(F.col("point").alias(p), F.col("n").alias(n), F.col("bits").alias(v)) for p, n, v in (("a", "m", "x"), ("b", "n", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long, least double, near boolean")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, either): sizes of the intersection and union of each pair of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, either = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                k = int((q[at] == p).sum())
                same.append(k)
                either.append(len(p) + len(q) - k)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "same", "either"])

    full = pairs.join(sets.select(F.col("point").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("point").alias("b"), F.col("items").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, same long, either long")


def _linked(over: DataFrame) -> DataFrame:
    return over.filter(F.lit(100) * F.col("same") >= F.lit(SAME) * F.col("either")).select("a", "b")


def _may_link(left: str, right: str):
    """Whether points of these aliases can be within EPS, meeting in their first common shingle: by size, role and place."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    most = F.least(n - F.col(f"{left}pos"), m - F.col(f"{right}pos"))
    roles = (F.col(f"{left}holds") & (n <= m)) | (F.col(f"{right}holds") & (m <= n))
    return roles & (F.lit(100) * F.least(n, m) >= F.lit(SAME) * F.greatest(n, m)) & (F.lit(100 + SAME) * most >= F.lit(SAME) * (n + m))


def _regions(members: DataFrame, shared: DataFrame) -> DataFrame:
    """(cell, point, n, pos, holds, q) of every region of a shingle and a size with two points; q is the least point that holds it.

    All of it follows the one exchange by shingle.
    """
    rows = members.filter("cell IS NOT NULL").select("cell", "point", "n", "pos").join(shared, "cell").dropDuplicates(["cell", "point"])
    size = lambda n: F.floor(F.log(n) / np.log(100 / SAME)).cast("int")
    sizes = F.sequence(size(F.ceil(F.col("n") * SAME / 100)), size(F.col("n")))
    rows = rows.withColumn("size", F.explode(sizes)).withColumn("holds", _holds("n", "pos") & (F.col("size") == size(F.col("n"))))
    at = Window.partitionBy("cell", "size")
    first = F.min(F.when(F.col("holds"), F.struct("point", "n", "pos", "holds"))).over(at)
    some = rows.withColumns({"q": first, "lo": F.min("point").over(at), "hi": F.max("point").over(at)}).filter("q IS NOT NULL AND lo <> hi")
    return some.select(F.xxhash64("cell", "size").alias("cell"), "point", "n", "pos", "holds", "q")


def _open(region: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``region`` with the labels so far, the number of members and that of members outside the largest component; only regions that may hold a link between two components."""
    rows = region.select("cell", "point", "n", "pos", "holds", "home")
    rows = rows.withColumn("label", F.col("point")) if labels is None else rows.join(labels.withColumnRenamed("node", "point"), "point", "left").withColumn("label", F.coalesce("label", "point"))
    per = rows.groupBy("cell", "label").agg(F.count("*").alias("k"), F.max("holds").alias("any"), F.max("home").alias("at_home"))
    per = per.groupBy("cell").agg(F.sum("k").alias("members"), F.max(F.struct("k", "label")).alias("top"), F.max("any").alias("any"), F.max("at_home").alias("at_home"))
    per = per.filter("any AND at_home AND top.k < members").select("cell", "members", (F.col("members") - F.col("top.k")).alias("others"), F.col("top.label").alias("top"))
    return rows.join(per, "cell")


def _same(one: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of the sets laid end to end."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    run = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(one[at] == flat, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def _side(part: pa.Table, lead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Points, labels, parity bitmaps and sets of one side of a meeting."""
    part = part.filter(pc.equal(part.column("lead"), lead)).combine_chunks()
    raw = [np.frombuffer(x, np.uint8) for x in part.column("bits").to_pylist()]
    return np.asarray(part.column("point")), np.asarray(part.column("label")), np.array(raw, np.uint8).reshape(len(raw), -1), [np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]


def _distances(part: pa.Table) -> pa.Table:
    """(cell, point, pivot, d, linked) of the points and pivots of one meeting."""
    pivots, _, _, heads = _side(part, True)
    points, _, _, sets = _side(part, False)
    size = np.array([len(x) for x in sets], np.int64)
    first, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate([*sets, np.zeros(0, np.uint64)])
    same = np.array([_same(one, flat, first) for one in heads], np.int64).reshape(len(heads), len(size))
    either = np.array([len(x) for x in heads], np.int64)[:, None] + size - same
    cell = pa.array(np.full(same.size, part.column("cell")[0].as_py(), np.int64))
    return pa.table({"cell": cell, "point": np.tile(points, len(pivots)), "pivot": np.repeat(pivots, len(points)), "d": (1 - same / either).ravel(), "linked": (100 * same >= SAME * either).ravel()})


def _near_by_bits(one: np.ndarray, many: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """Which of many sets can be within EPS of one, by their parity bitmaps."""
    differ = np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64) if len(many) else size
    return (100 + SAME) * differ <= (100 - SAME) * (size + n)


def _new_links(part: pa.Table, may: Callable[..., np.ndarray] = _near_by_bits) -> pa.Table:
    """Links (a, b) of one meeting that join components which were not joined before them; ``may`` tells which sets can be near by what is kept of them."""
    xs, x_labels, x_bits, x_sets = _side(part, True)
    ys, y_labels, y_bits, y_sets = _side(part, False)
    names, roots = np.unique(np.concatenate([x_labels, y_labels]), return_inverse=True)
    x_root, y_root = roots[: len(xs)], roots[len(xs) :]
    up = np.arange(len(names))  # the component of each label, as joined here
    size, out = np.array([len(v) for v in y_sets], np.int64), []
    for i, one in enumerate(x_sets):
        n = len(one)
        near = may(x_bits[i], y_bits, n, size) & (100 * np.minimum(size, n) >= SAME * np.maximum(size, n))
        todo = np.flatnonzero(near & (up[y_root] != up[x_root[i]]))
        while len(todo):  # a few at a time: once components are joined, the rest of their pairs is settled
            some = todo[:32]
            first = np.concatenate([[0], np.cumsum(size[some])])
            same = _same(one, np.concatenate([y_sets[k] for k in some]), first)
            for k in some[100 * same >= SAME * (n + size[some] - same)].tolist():
                if up[y_root[k]] != up[x_root[i]]:
                    up[up == up[y_root[k]]] = up[x_root[i]]
                    out.append((int(xs[i]), int(ys[k])))
            todo = todo[32:]
            todo = todo[up[y_root[todo]] != up[x_root[i]]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


class _Links:
    """Measures pairs of points and keeps the components of the links found."""

    #: What the bits kept of two sets say about them.
    may = staticmethod(_near_by_bits)

    def __init__(self, docs: DataFrame, points: DataFrame, bitmaps: DataFrame, seed: int, words: int = WORDS) -> None:
        self.docs, self.points, self.bitmaps, self.seed, self.words = docs, points.select("point", "doc_id"), bitmaps, seed, words
        self.labels: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that can still be within EPS."""
        return _bounds(pairs, self.bitmaps).filter("near").select("a", "b")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(point, items) of the points of ``wanted``; only one document of each is read for it."""
        ids = cut(wanted.select("point").distinct().join(self.points, "point").groupBy("point").agg(F.min("doc_id").alias("doc_id")))
        rows = ids.count()
        if rows <= SENT_IDS:  # 16 bytes each
            some = self.docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").unionByName(self.docs.filter("doc_id IS NULL"))
            return _sets(some, None, self.seed, self.words).join(F.broadcast(ids.select("point")), "point", "left_semi").dropDuplicates(["point"])
        bits = bits_of(ids.filter("doc_id IS NOT NULL"), "doc_id", FILTER_BITS)
        return _sets(self.docs, bits, self.seed, self.words).join(ids.select("point"), "point", "left_semi").dropDuplicates(["point"])

    def add(self, links: DataFrame) -> None:
        links = cut(links)
        if self.labels is not None:  # the labels so far are stars that stand for all links before
            if links.isEmpty():
                return
            links = self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)
        self.labels = cut(components(links))

    def meet(self, rows: DataFrame) -> None:
        """Links of the points outside a region's largest component with all others."""
        if not rows.isEmpty():
            lead = rows.select("cell", "point", "label", (F.col("label") != F.col("top")).alias("lead"))
            may = self.may
            self.add(self.meetings(lead).applyInArrow(lambda x: _new_links(x, may), "a long, b long"))

    def try_pairs(self, pairs: DataFrame) -> None:
        near = cut(self.near(pairs.distinct()))
        if self.labels is not None and near.isEmpty():
            return
        self.add(_linked(_overlaps(near, self.sets_of(near.select(F.explode(F.array("a", "b")).alias("point"))))))

    def meetings(self, rows: DataFrame) -> GroupedData:
        """Every lead point of a cell with every point of it, block by block; rows: cell, point, label, lead."""
        full = rows.join(self.bitmaps, "point").join(self.sets_of(rows), "point").select("cell", "point", "label", "lead", "bits", "items", (8 * F.col("n") + 300).alias("bytes"))
        blocks = lambda x: F.greatest(F.ceil(F.sum(x) / BLOCK_BYTES), F.lit(1)).cast("int")
        per = rows.join(self.bitmaps, "point").groupBy("cell").agg(blocks(F.when(F.col("lead"), 8 * F.col("n") + 300).otherwise(0)).alias("xs"), blocks(8 * F.col("n") + 300).alias("ys"))
        full = full.join(per, "cell")
        deal = lambda n, seed: F.pmod(F.xxhash64("point", F.lit(seed)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keep = ["cell", "point", "label", "bits", "items"]
        left = full.filter("lead").withColumn("x", deal("xs", 1)).withColumn("y", each("ys")).select(*keep, F.lit(True).alias("lead"), "x", "y")
        right = full.withColumn("y", deal("ys", 2)).withColumn("x", each("xs")).select(*keep, F.lit(False).alias("lead"), "x", "y")
        return left.union(right).groupBy("cell", "x", "y")


def _divide(big: DataFrame, links: _Links, level: int) -> DataFrame:
    """The Voronoi regions, with guests, of pivots of each region; those that this doesn't make much smaller are joined here."""
    chosen = (F.col("label") != F.col("top")) & (F.pmod(F.xxhash64("point", F.lit(level)), F.col("others")) < PIVOTS)
    rows = cut(big.withColumn("lead", chosen))
    d = cut(links.meetings(rows.select("cell", "point", "label", "lead")).applyInArrow(lambda x: _distances(x), "cell long, point long, pivot long, d double, linked boolean"))
    links.add(d.filter("linked AND point <> pivot").select(F.col("point").alias("a"), F.col("pivot").alias("b")))
    rest = rows.filter("NOT lead").drop("lead")
    placed = d.join(rest.select("cell", "point", "home"), ["cell", "point"]).withColumn("nearest", F.min(F.struct("d", "pivot")).over(Window.partitionBy("cell", "point")))
    placed = placed.filter(F.col("d") <= F.col("nearest.d") + 2 * EPS + 1e-12).withColumn("near", F.col("pivot") == F.col("nearest.pivot"))
    placed = cut(placed.select("cell", "point", "pivot", "near"))
    parts = placed.groupBy("cell", "pivot").agg(F.count("*").alias("copies"), F.count(F.when(F.col("near"), 1)).alias("points")).groupBy("cell").agg(F.sum("copies").alias("copies"), F.sum("points").alias("points"), F.max("copies").alias("most"))
    split = parts.filter("2 * copies <= 3 * points AND 4 * most <= 3 * points").select("cell")
    links.meet(cut(_open(rest.join(split, "cell", "left_anti"), links.labels)))
    divided = rest.join(placed, ["cell", "point"]).join(split, "cell", "left_semi")
    return cut(divided.select(F.xxhash64("cell", "pivot").alias("cell"), "point", "n", "pos", "holds", (F.col("home") & F.col("near")).alias("home")))


def link_points(docs: DataFrame, points: DataFrame, levels: np.ndarray, seed: int) -> DataFrame:
    """(node, label) of the points(doc_id, point) that have a link."""
    held = _cells(docs, levels, seed).groupBy("cell").agg(F.min("point").alias("lo"), F.max("point").alias("hi"), F.max("holds").alias("any"))
    shared = cut(held.filter("lo <> hi AND any").select("cell"))
    cell_bits = min(MOST_CELL_BITS, max(LEAST_CELL_BITS, (8 * shared.count()).bit_length()))
    members = written(_members(docs, levels, seed, bits_of(shared, "cell", cell_bits), cell_bits))
    regions = cut(_regions(members, shared))
    bitmaps = cut(members.filter("bits IS NOT NULL").select("point", F.col("n").cast("long").alias("n"), "bits").dropDuplicates(["point"]))
    return join_regions(regions, _Links(docs, points, bitmaps, seed))


def join_regions(regions: DataFrame, links: _Links) -> DataFrame | None:
    """(node, label) of the points that have a link, from regions (cell, point, n, pos, holds, q) in which all linked points meet: steps 2 to 4."""
    star = regions.filter(F.col("point") != F.col("q.point")).filter(_may_link("", "q."))
    links.try_pairs(star.select(F.greatest("point", "q.point").alias("a"), F.least("point", "q.point").alias("b")))
    region, level = regions.withColumn("home", F.lit(True)), 0
    while True:
        rows = cut(_open(region, links.labels))
        few = rows.filter(F.col("members") <= SMALL)
        met = few.alias("x").join(few.alias("y"), "cell").filter("x.point < y.point AND x.label <> y.label AND (x.home OR y.home)").filter(_may_link("x.", "y."))
        links.try_pairs(met.select(F.col("x.point").alias("a"), F.col("y.point").alias("b")))
        big = rows.filter(F.col("members") > SMALL)
        if level == 0:  # the large regions of one first pivot become one; the shingle's place says nothing in it
            if big.isEmpty():
                return links.labels
            pivots = regions.select("cell", F.col("q.point").alias("pivot")).distinct()
            merged = big.select("cell", "point", "n").join(pivots, "cell").select(F.col("pivot").alias("cell"), "point", "n").distinct()
            big = cut(_open(merged.select("cell", "point", "n", F.lit(0).alias("pos"), F.lit(True).alias("holds"), F.lit(True).alias("home")), links.labels))
        links.meet(big.filter(F.col("members") <= MEETING))
        wide = big.filter(F.col("members") > MEETING)
        if wide.isEmpty():
            return links.labels
        region, level = _divide(wide, links, level), level + 1


def _labelled(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n, point and the component's label for every row, and the seed of the points."""
    for seed in range(8):
        rows = cut(_points_and_sketch(docs, seed))
        points = rows.filter("block IS NULL").select("doc_id", "n", "point", "check")
        # Two sets under one 64-bit id would be taken for one: then all ids are made anew.
        if points.filter("n > 0").groupBy("point").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").isEmpty():
            break
    labels = link_points(docs, points, _levels(rows), seed)
    return points.join(labels.withColumnRenamed("node", "point"), "point", "left").select("doc_id", "n", "point", F.coalesce("label", "point").alias("label")), seed


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    named, _ = _labelled(only(docs, {"doc_id": "long", "text": "string"}))
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_points(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the id (_id), number of shingles (_n) and point (_point) of each row."""
    pair = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            at = 0
            for ids, n, point, _, _, _ in _batches(iter([batch.select(["doc_id", "text"])]), seed):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(n)), ids, pa.array(n, pa.int64()), pa.array(point)], names=["row", "_id", "_n", "_point"])
                at += len(n)

    return pair.mapInArrow(run, pair.select("row").schema.add("_id", "long").add("_n", "long").add("_point", "long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row of each component: that with the least id, and of equal ids that with the least point.

    Rows of a component without any id count too, after those with one.  Texts without a word are in no
    component: one row of each id stays, and all without an id.
    """
    named, seed = _labelled(only(docs, {"doc_id": "long", "text": "string"}))
    found = cut(named)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "point")
    words = found.filter("n > 0").groupBy("label").agg(F.min(order).alias("r")).select("r.doc_id", "r.point")
    again = found.filter("n > 0 OR doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 OR doc_id IS NULL")
    if again.isEmpty():  # an id tells the row
        keep = words.select("doc_id").union(found.filter("n = 0").select("doc_id")).select(F.col("doc_id").alias("_keep"))
        return docs.join(keep, docs["doc_id"].cast("long") == keep["_keep"], "left_semi").union(docs.filter("doc_id IS NULL"))
    rows = _with_points(docs, seed)
    keep = words.toDF("_keep", "_kept")
    first = rows.filter("_n > 0").join(keep, rows["_id"].eqNullSafe(keep["_keep"]) & (rows["_point"] == keep["_kept"]), "left_semi").dropDuplicates(["_id", "_point"])
    rest = rows.filter("_n = 0 AND _id IS NOT NULL").dropDuplicates(["_id"])
    out = first.unionByName(rest).unionByName(rows.filter("_n = 0 AND _id IS NULL"))
    return out.select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
