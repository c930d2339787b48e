"""Benchmark decontamination with a block-max BM25 index (operator 5).

Words are runs of letters, digits and bytes beyond ASCII, lower-cased in ASCII and Latin-1.  Every
benchmark item is indexed with its BM25 impacts, divided by the item's score against itself, so that
one threshold serves all items; items lie in blocks, and each term keeps its largest impact in a
block.  Number and mean length of the items and the items that hold a term are counted once over the
whole benchmark, by a grouped aggregation, so an item's scores are the same however the benchmark is cut
into indexes.  Every passage of every document (two runs of ``stride`` words, each run shared by two
passages) is a query; the stride is the item's own, 64 words or the next power of two that its length
needs, and an index holds items of one stride.  Frequent terms of an item are set aside as in MaxScore while their sum stays
below the threshold (the rest of its terms lead to it, so an item of frequent terms only is found
too), with their block totals as bound; blocks whose bound stays below the threshold are skipped, the
others are scored exactly, and what reaches the threshold is verified: the item's question and its answer (its last sentence unless
given) must both overlap the document in word shingles.

Defined cases: null or empty texts match nothing; items without a word are never matched; repeated
items and rows each give their pairs; null ids stay null; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import bound_batches, cut, only, pieces, span_hashes, table, text_bytes, window_hashes, words_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Shingle length of the verification, and the least share of question and of answer shingles found.
SHINGLE, QUESTION, ANSWER = 3, 0.5, 0.5
BLOCK = 8
#: Words of a run, for items of up to so many words; longer ones take the next power of two.
STRIDE = 64
#: Items and characters indexed at once: an index is sent to every executor, so larger benchmarks go in shards of this size.
SHARD_ITEMS, SHARD_CHARS = 20_000, 16 << 20
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

_WORD_SEP = np.ones(256, bool)
_WORD_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[wide] += 0x20
    return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    s, e, row = words_of(data, off, _WORD_SEP)
    return span_hashes(data, s, e), row


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(window_hashes(h, min(SHINGLE, max(1, len(h)))))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that comes as one text: its last sentence is the answer."""
    ends = [m.end() for m in re.finditer(r"[.!?:]\s+|\n+", text.strip())]
    at = ends[-1] if ends else 0
    return (text.strip()[:at], text.strip()[at:]) if at else (text, text)


def _words_of_item(q: str, a: str) -> np.ndarray:
    return _hashes(f"{q}\n{a}" if a is not q else q)


def stride_of(words: int) -> int:
    return max(STRIDE, 1 << (words - 1).bit_length()) if words else STRIDE


class Statistics(NamedTuple):
    """Of the whole benchmark: its items and their mean length; of each of the terms (sorted), the items that hold it."""

    items: int
    mean_length: float
    terms: np.ndarray
    held_by: np.ndarray


def statistics_of(items: list[tuple[int, str, str]]) -> Statistics:
    """Those of a benchmark that is a list."""
    rows = [x for x in (_words_of_item(q, a) for _, q, a in items) if len(x)]
    terms, df = np.unique(np.concatenate([*(np.unique(x) for x in rows), np.zeros(0, np.uint64)]), return_counts=True)
    return Statistics(len(rows), sum(map(len, rows)) / max(1, len(rows)), terms, df)


class Index:
    """Postings of a shard of the benchmark, all of one stride, as flat arrays."""

    def __init__(self, items: list[tuple[int, str, str]], whole: Statistics, stride: int, threshold: float = THRESHOLD) -> None:
        self.threshold, self.stride = threshold, stride
        rows = [(i, _words_of_item(q, a), _shingles(_hashes(q)), _shingles(_hashes(a))) for i, q, a in items]
        rows = [r for r in rows if len(r[1])]
        self.ids = [r[0] for r in rows]
        self.question, self.answer = [r[2] for r in rows], [r[3] for r in rows]
        n = len(rows)
        self.n, self.blocks = n, -(-n // BLOCK)
        if not n:
            return
        item = np.repeat(np.arange(n), [len(r[1]) for r in rows])
        self.terms, term = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        (key, tf) = np.unique(term * n + item, return_counts=True)
        term, item = key // n, key % n
        length = np.array([len(r[1]) for r in rows])
        df = whole.held_by[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((whole.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / whole.mean_length))
        impact /= np.bincount(item, weights=impact, minlength=n)[item]
        self.post_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.post_item, self.post_impact = item, impact
        block = item // BLOCK
        bkey, which = np.unique(term * self.blocks + block, return_inverse=True)
        most = np.zeros(len(bkey))
        np.maximum.at(most, which, impact)
        # The most frequent terms of an item stay out of the candidate search while their sum is below the threshold:
        # what reaches it holds another of its terms.  A term seeds a block if it seeds any of its items; the total of
        # the others in any item of the block bounds what they add.
        frequent = df[term] > max(2, whole.items // 20)
        order = np.lexsort((term, -df[term], item))
        aside = np.cumsum(np.where(frequent, impact, 0.0)[order])
        first = np.searchsorted(item[order], np.arange(n))
        aside -= np.concatenate([[0.0], aside])[first][item[order]]
        seeds = ~frequent
        seeds[order] |= aside >= threshold - 1e-6
        seed = np.zeros(len(bkey), bool)
        seed[which[seeds]] = True
        usual = np.bincount(item, weights=np.where(seed[which], 0.0, impact), minlength=n)
        self.usual = np.zeros(self.blocks)
        np.maximum.at(self.usual, np.arange(n) // BLOCK, usual)
        bkey = bkey[seed]
        self.seed_at = np.searchsorted(bkey // self.blocks, np.arange(len(self.terms) + 1))
        self.seed_block, self.seed_most = bkey % self.blocks, most[seed]


def _spread(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all postings of the terms, and for each the place of its term."""
    n = at[term + 1] - at[term]
    total = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(at[term] - total[:-1], n) + np.arange(total[-1]), np.repeat(np.arange(len(term)), n)


def search(index: Index, h: np.ndarray, row: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of every passage and item at or above the threshold."""
    if threshold < index.threshold:
        raise ValueError(f"the index serves thresholds from {index.threshold}, not {threshold}")
    if not index.n or not len(h):
        return []
    first = np.searchsorted(row, np.arange(row[-1] + 2))  # first word of each row
    run_base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // index.stride) + 1)])
    run = run_base[row] + (np.arange(len(h)) - first[row]) // index.stride  # an empty run parts the rows
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = index.terms[at] == h
    key = np.unique(run[hit] * len(index.terms) + at[hit])
    run_of, term = key // len(index.terms), key % len(index.terms)
    # Each passage is two runs; a term that both hold counts once.
    passage = np.concatenate([run_of, run_of - 1])
    key = np.unique(passage * len(index.terms) + np.concatenate([term, term]))
    key = key[key >= 0]
    passage, term = key // len(index.terms), key % len(index.terms)
    lead = np.flatnonzero(index.seed_at[term + 1] > index.seed_at[term])
    post, of = _spread(index.seed_at, term[lead])
    if not len(post):
        return []
    bkey = passage[lead][of] * index.blocks + index.seed_block[post]
    keys, which = np.unique(bkey, return_inverse=True)
    bound = np.bincount(which, weights=index.seed_most[post]) + index.usual[keys % index.blocks]
    keys = keys[bound >= threshold - 1e-9]
    if not len(keys):
        return []
    # Exact scores in the blocks that are left.
    live = np.unique(keys // index.blocks)
    some = np.flatnonzero(np.isin(passage, live))
    post, of = _spread(index.post_at, term[some])
    item = index.post_item[post]
    bkey = passage[some][of] * index.blocks + item // BLOCK
    ok = np.isin(bkey, keys)
    ikey, which = np.unique((passage[some][of] * index.n + item)[ok], return_inverse=True)
    score = np.bincount(which, weights=index.post_impact[post][ok])
    good = score >= threshold - 1e-9
    out = []
    for k, s in zip(ikey[good].tolist(), score[good].tolist(), strict=True):
        p, i = divmod(k, index.n)
        r = int(np.searchsorted(run_base, p, side="right")) - 1
        a = int(first[r]) + (p - int(run_base[r])) * index.stride
        out.append((r, i, s, a, min(a + 2 * index.stride, int(first[r + 1]))))
    return out


def _share(part: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(part, have).mean()) if len(part) else 1.0


def verify(index: Index, h: np.ndarray, found: list[tuple[int, int, float, int, int]]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) -> best score, question overlap, answer overlap, for the pairs that hold."""
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for r, i, s, a, b in found:
        words = h[max(a, 0) : b]
        q = _share(index.question[i], window_hashes(words, k) if (k := min(SHINGLE, _size(index.question[i], index, i, 0))) else words)
        w = _share(index.answer[i], window_hashes(words, k) if (k := min(SHINGLE, _size(index.answer[i], index, i, 1))) else words)
        if q >= QUESTION and w >= ANSWER and s > out.get((r, i), (-1.0,))[0]:
            out[r, i] = (s, q, w)
    return out


def _size(part: np.ndarray, index: Index, item: int, which: int) -> int:
    return index.width[item][which]


def build_index(items: list[tuple[int, str, str]], threshold: float = THRESHOLD, whole: Statistics | None = None, stride: int | None = None) -> Index:
    """An index of the items; on its own it takes them for the whole benchmark, and the stride that the longest needs."""
    stride = stride or max([stride_of(len(_words_of_item(q, a))) for _, q, a in items], default=STRIDE)
    index = Index(items, whole or statistics_of(items), stride, threshold)
    kept = [(q, a) for _, q, a in items if len(_words_of_item(q, a))]
    index.width = [(min(SHINGLE, max(1, len(_hashes(q)))), min(SHINGLE, max(1, len(_hashes(a))))) for q, a in kept]
    return index


def _parts(q: str | None, a: str | None) -> tuple[str, str]:
    return split_item(q or "") if a is None else (q or "", a)


def _with_words(items: DataFrame) -> DataFrame:
    """item_id, q, a of the items that have a word, with their number of words, stride and distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "q", 1 << 20):
            words = [_words_of_item(*_parts(q, a)) for q, a in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist(), strict=True)]
            sizes = [len(x) for x in words]
            terms = pa.array([np.unique(x).view(np.int64) for x in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array([stride_of(n) for n in sizes], pa.int64()), terms], names=[*batch.schema.names, "words", "stride", "terms"]).filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return items.mapInArrow(run, "item_id long, q string, a string, words long, stride long, terms array<long>")


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Indexes of the benchmark's shards.  ``benchmark`` has item_id and text, or question and answer."""
    bound_batches(benchmark.sparkSession)
    whole = "question" not in benchmark.columns
    items = benchmark.select(F.col("`item_id`").cast("long"), *([F.col("`text`").cast("string"), F.lit(None).cast("string")] if whole else [F.col("`question`").cast("string"), F.col("`answer`").cast("string")])).toDF("item_id", "q", "a")
    items = cut(_with_words(items))
    held = cut(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    chars = F.length(F.coalesce("q", F.lit(""))) + F.length(F.coalesce("a", F.lit("")))
    sizes = items.groupBy("stride").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.sum("words").alias("words")).orderBy("stride").collect()  # a row for each power of two
    total = sum(r["n"] for r in sizes)
    for r in sizes:
        shards = max(-(-r["n"] // SHARD_ITEMS), -(-r["chars"] // SHARD_CHARS))
        for k in range(shards):
            mine = items.filter((F.col("stride") == r["stride"]) & (F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(shards)) == k))
            rows = mine.select("item_id", "q", "a").orderBy("item_id", "q", "a").collect()
            terms = mine.select(F.explode("terms").alias("term")).distinct().join(held, "term").toArrow()
            term, df = np.asarray(terms.column("term")).view(np.uint64), np.asarray(terms.column("n"))
            order = np.argsort(term)
            yield build_index([(x["item_id"], *_parts(x["q"], x["a"])) for x in rows], threshold, Statistics(total, sum(x["words"] for x in sizes) / total, term[order], df[order]), r["stride"])


def _pairs(index: Index, texts: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    h, row = word_hashes(*text_bytes(texts))
    return verify(index, h, search(index, h, row, threshold))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it leaks."""
    parts = []
    for index in indexes(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            for batch in pieces(batches, "text", 2 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], shared.value.ids[i], *found) for (r, i), found in _pairs(shared.value, batch.column("text"), threshold).items()]
                cols = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in PAIRS.split(", ")])

        parts.append(only(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, PAIRS))
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for x in parts:
        out = out.unionByName(x)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that leak no item, in one pass without a shuffle for each shard of the benchmark."""
    bound_batches(docs.sparkSession)
    for index in indexes(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", 2 << 20):
                text = batch.column(batch.schema.get_field_index("text"))
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in _pairs(shared.value, text, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
