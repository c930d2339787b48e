"""Repeated 200-byte strings by suffix order and longest-previous-factor tests (operator 7).

A full suffix array of the corpus would hold a row per byte.  It is built only where it can matter:

1. Every window of ``WINDOW`` bytes has an anchor, the least hash of its 50-byte strings; equal windows
   have equal anchors.  Consecutive windows under one anchor form a stretch, known by its anchor and
   the hash of its bytes.  Anchors that stand once in the corpus end here.
2. Stretches that stand twice or more are repeated whole.
3. Anchors with several different stretches get a suffix array of one copy of each: ranks of suffixes
   by prefix doubling up to the window length.  In suffix order, ties by position, the previous
   smaller position of a suffix is its neighbour, and its longest previous factor reaches the window
   length just when that neighbour has the same rank; the next smaller position gives the longest next
   factor in the same way.  The previous factor finds the later copies and the next factor the first
   ones; ``keep_first`` inside a stretch group is the former alone, the contract asks for both.
   Groups beyond ``GROUP`` stretches are counted window by window instead, with partial sums.
4. The spans found are gathered per distinct text, and each text loses their union.

Defined cases: a null or empty text has no bytes, nothing removed and the digest of no bytes; texts
shorter than the window lose nothing; repeated rows are copies of each other; null ids stay null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.bits import bits_of, test_bits
from corvid.llm.common import cut, mix, only, pieces, span_hashes, table, text_bytes

WINDOW, GRAM = 200, 50
SPAN = WINDOW - GRAM + 1
#: Bytes of one text handled at once; window positions must fit in 24 bits.
SLICE = 8 << 20
#: Bits of the filters of anchors and stretches: eight a key, in these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 20, 27
#: Stretches of one anchor that go through one suffix array.
GROUP = 8192


_BASE = 0x9E3779B97F4A7C15
#: One random 64-bit value for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hashes of each ``GRAM`` bytes.  They only choose anchors: strings that share a hash by chance cost work, not results."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], _powers(_BASE, len(data)), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    h = sums[GRAM:] - sums[:-GRAM]
    h *= _powers(pow(_BASE, -1, 1 << 64), len(h))
    return mix(h)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor and content hash of each stretch of texts laid end to end."""
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if len(data) > SLICE + WINDOW:
        parts = []
        for base in range(0, len(data) - WINDOW + 1, SLICE):
            end = min(len(data), base + SLICE + WINDOW - 1)
            s, m, a, c = stretches(data[base:end], np.unique(np.clip(off - base, 0, end - base)))
            parts.append((s + base, m, a, c))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    h = gram_hashes(data)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    n = len(data) - WINDOW + 1
    rows = np.concatenate([key, np.full(-len(key) % SPAN, 2**64 - 1, np.uint64)]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n])
    # Windows that cross a border of texts do not count.
    ok = np.ones(n, bool)
    for k in range(1, WINDOW):
        at = off[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    edge = off[(off > 0) & (off < n)]
    new[edge] = True
    bounds = np.flatnonzero(new)
    start, end = bounds[:-1], bounds[1:]
    good = ok[start]
    start, end = start[good], end[good]
    return start, end - start, h[(least[start] & np.uint64(0xFFFFFF)).astype(np.int64)] >> np.uint64(16), span_hashes(data, start, end + WINDOW - 1)


def filter_bits(keys: DataFrame) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))


def _text_id(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batches(batches: Iterator[pa.RecordBatch]):
    for batch in pieces(batches, "text", 2 << 20):
        data, off = text_bytes(batch.column("text"))
        yield batch, data, off, *stretches(data, off)


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, mixed) of the anchors that stand more than once; mixed: with different stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, _, a, c in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["anchor", "content"])

    rows = docs.select("text").mapInArrow(run, "anchor long, content long")
    return rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))


def _occurrences(docs: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """(anchor, content, t1, t2, start, m) of the stretches whose anchor may stand more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off, s, m, a, c in _batches(batches):
            pick = np.flatnonzero(test_bits(shared.value, mix(a.copy()), bits))
            row = np.searchsorted(off, s[pick], side="right") - 1
            ids = {int(r): _text_id(data[off[r] : off[r + 1]].tobytes()) for r in np.unique(row)}
            t = np.array([ids[r] for r in row.tolist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[pick].view(np.int64)), pa.array(c[pick].view(np.int64)), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array((s[pick] - off[row])), pa.array(m[pick].astype(np.int32))], names=["anchor", "content", "t1", "t2", "start", "m"])

    return docs.select("text").mapInArrow(run, "anchor long, content long, t1 long, t2 long, start long, m int")


def _stretch_key(content: np.ndarray, t1: np.ndarray) -> np.ndarray:
    return mix(content.view(np.uint64) * np.uint64(3) + t1.view(np.uint64))


def _stretch_bytes(docs: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """(anchor, content, raw): the bytes of the stretches that were chosen to stand for their content."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off, s, m, a, c in _batches(batches):
            row = np.searchsorted(off, s, side="right") - 1
            t1 = np.array([_text_id(data[off[r] : off[r + 1]].tobytes())[0] if off[r + 1] - off[r] >= WINDOW else 0 for r in range(len(off) - 1)], np.int64)
            pick = np.flatnonzero(test_bits(shared.value, _stretch_key(c, t1[row]), bits))
            _, first = np.unique(c[pick], return_index=True)
            pick = pick[first]
            raw = [data[x : x + k + WINDOW - 1].tobytes() for x, k in zip(s[pick].tolist(), m[pick].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[pick].view(np.int64)), pa.array(c[pick].view(np.int64)), pa.array(raw, pa.binary())], names=["anchor", "content", "raw"])

    return docs.select("text").mapInArrow(run, "anchor long, content long, raw binary")


def suffix_ranks(data: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Ranks, in lexicographic order, of the suffixes of ``data`` cut at ``length`` bytes, by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    have = 8
    while have < length:
        step = min(have, length - have)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    return rank


def factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous and the longest next factor at each of the positions reach the rank's length."""
    order = np.lexsort((position, rank))
    same = rank[order[1:]] == rank[order[:-1]]
    previous, following = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    previous[order[1:]] = same
    following[order[:-1]] = same
    return previous, following


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _repeated_in(raws: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each stretch the runs of its windows that stand elsewhere in these stretches."""
    size = np.array([len(r) for r in raws])
    begin = np.concatenate([[0], np.cumsum(size)])
    rank = suffix_ranks(np.frombuffer(b"".join(raws), np.uint8))
    at = np.concatenate([np.arange(b, b + n - WINDOW + 1) for b, n in zip(begin[:-1], size, strict=True)])
    previous, following = factors(rank[at], at)
    hit = np.zeros(begin[-1], bool)
    hit[at] = previous | following
    return [_runs(hit[b : b + n - WINDOW + 1]) for b, n in zip(begin[:-1], size, strict=True)]


MARKS = "anchor long, content long, lo int, hi int"


def _by_suffix_array(stretches_df: DataFrame) -> DataFrame:
    """Repeated window runs (lo, hi) of the stretches, anchor by anchor in a sorted stream."""

    def out(anchors: list, contents: list, raws: list[bytes]) -> pa.RecordBatch:
        rows = [(a, c, lo, hi) for a, c, runs in zip(anchors, contents, _repeated_in(raws), strict=True) for lo, hi in runs]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "content", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, contents, raws, size = [], [], [], 0
        for batch in batches:
            for a, c, r in zip(batch.column("anchor").to_pylist(), batch.column("content").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if size > (1 << 19) and a != anchors[-1]:
                    yield out(anchors, contents, raws)
                    anchors, contents, raws, size = [], [], [], 0
                anchors.append(a)
                contents.append(c)
                raws.append(r)
                size += len(r)
        if raws:
            yield out(anchors, contents, raws)

    return stretches_df.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, MARKS)


def _by_counts(stretches_df: DataFrame) -> DataFrame:
    """The same for anchors with very many stretches: windows are counted by hash, summed before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c, r in zip(batch.column("anchor").to_pylist(), batch.column("content").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                data = np.frombuffer(r, np.uint8)
                at = np.arange(len(data) - WINDOW + 1)
                h = span_hashes(data, at, at + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), a)), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["anchor", "content", "lo", "h"])

    windows = stretches_df.mapInArrow(run, "anchor long, content long, lo int, h long")
    twice = windows.groupBy("anchor", "h").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "h")
    return windows.join(twice, ["anchor", "h"]).select("anchor", "content", "lo", (F.col("lo") + 1).alias("hi"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_texts(docs: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, off = text_bytes(batch.column("text"))
            ids = np.array([_text_id(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["doc_id", "text", "t1", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            n_bytes, removed, n_spans, digest, texts = [], [], [], [], []
            for text, los, his in zip(batch.column("text"), batch.column("los").to_pylist(), batch.column("his").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, gone, count = [], 0, 0, 0
                end = -1
                for lo, hi in sorted(zip(los or [], his or [], strict=True)):
                    if lo > end:  # spans that touch are one
                        kept.append(raw[at:lo])
                        count += 1
                        gone -= lo
                        gone += hi
                        at = end = hi
                    elif hi > end:
                        gone += hi - end
                        at = end = hi
                rest = b"".join([*kept, raw[at:]])
                n_bytes.append(len(raw))
                removed.append(gone)
                n_spans.append(count)
                digest.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "ignore") if with_text else None)
            cols = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, names=[c.split()[0] for c in RESULT.split(", ")] + ["kept_text"] * with_text)

    keyed = docs.mapInArrow(key, "doc_id long, text string, t1 long, t2 long")
    return keyed.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "los", "his").mapInArrow(run, RESULT + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): bytes, removed bytes and spans, digest (and, if asked, text) of what is left."""
    docs = only(docs, {"doc_id": "long", "text": "string"})
    anchors = cut(_anchors(docs))
    bits = filter_bits(anchors)
    found = cut(_occurrences(docs, bits_of(anchors, "anchor", bits), bits).join(anchors, "anchor"))
    contents = cut(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("t1").alias("t1"), F.max("mixed").alias("mixed")))
    mixed = contents.filter("mixed").select("anchor", "content", "t1")
    bits = filter_bits(mixed)
    chosen = _stretch_bytes(docs, bits_of(mixed, ["content", "t1"], bits, _stretch_key), bits)
    of_anchor = mixed.groupBy("anchor").agg(F.count("*").alias("many"))
    raws = cut(chosen.dropDuplicates(["anchor", "content"]).join(of_anchor, "anchor"))
    partial = _by_suffix_array(raws.filter(F.col("many") <= GROUP).drop("many")).union(_by_counts(raws.filter(F.col("many") > GROUP).drop("many")))
    once = contents.filter("n = 1").select("anchor", "content")
    marks = contents.filter("n > 1").select("anchor", "content", F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi")).union(partial.join(once, ["anchor", "content"], "left_semi"))
    spans = found.join(marks, ["anchor", "content"]).select("t1", "t2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.coalesce("hi", "m") + (WINDOW - 1)).alias("hi"))
    spans = spans.groupBy("t1", "t2", "lo").agg(F.max("hi").alias("hi"))
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select("t1", "t2", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))
    return _cut_texts(docs, spans, with_text)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
