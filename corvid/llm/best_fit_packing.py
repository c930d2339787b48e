"""Best-fit packing, bound-certified (operator 10).

A document is its token ids, by a public byte-level BPE, then one end id 0.  Documents longer than
``capacity`` are cut into pieces of exactly ``capacity`` ids from the end, so that only the first
piece may be shorter.  The pieces' lengths (not their texts) are then packed:

* pieces are dealt into partitions of about ``group_rows`` rows; each runs best-fit decreasing;
* dual-feasible functions of the lengths give a lower bound on each partition's bin count, which
  certifies it when the bound is met;
* the bins of a partition that are not certified full enough (its gap) are dissolved: their pieces
  are exchanged with those of the other partitions and best-fit decreasing runs again, ``rounds``
  times at most; the last round's partitions may keep gaps, and ``certificate`` says how far the whole
  packing is from the bound.

Defined cases: a null or empty text is the single end id; null ids stay null; repeated rows are
packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import cut, only, pieces, span_hashes, table, text_bytes

CAPACITY = 2048
END = np.array([0], "<u4").tobytes()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: The tokenizer's special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", np.array([50256], "<u4")
#: Words that a worker remembers before it starts afresh.
MEMO = 200_000
_TWO_SPACES = re.compile(r"\s\s")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of the white space beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of whole texts, as little-endian uint32 bytes.

    The tokenizer splits a text before it merges bytes, and a single space or line feed between two
    other characters always begins a split of its own; so the ids of a text without adjacent white
    space are those of its words, each with its leading space, and of its line feeds.  The distinct
    words of a batch are encoded together, one to a line, and laid out by numpy; texts with adjacent
    white space, or with the tokenizer's special token, are encoded whole.  The ranks file holds the
    same vocabulary as the tokenizer file, which turns the special token's string into its id wherever
    it stands; a test compares their ids.
    """

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.feed = int(self.whole("\n")[0])
        self.forget()

    def forget(self) -> None:
        #: Place of each known word; and the known words' ids, in the order they came.
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        parts = [np.array(self.enc.encode_ordinary(x), "<u4") for x in text.split(SPECIAL)]
        return np.concatenate([x for p in parts for x in (SPECIAL_ID, p)][1:])

    def words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units laid end to end, and the n + 1 places where they begin."""
        texts = [u.decode("utf-8") for u in units]
        odd = {i: self.whole(t) for i, t in enumerate(texts) if (w := t[t[:1] == " " :]) != w.strip() or not w}
        plain = [i for i in range(len(texts)) if i not in odd]
        ids = np.array(self.enc.encode_to_numpy("\n".join([texts[i] for i in plain])), "<u4") if plain else np.zeros(0, "<u4")
        ends = np.append(np.flatnonzero(ids == self.feed), len(ids))[: len(plain)]
        length = np.zeros(len(texts), np.int64)
        length[plain] = np.diff(ends, prepend=-1) - 1
        begin = np.zeros(len(texts), np.int64)
        begin[plain] = ends - length[plain]
        at, extra = len(ids), []
        for i, x in odd.items():
            begin[i], length[i] = at, len(x)
            at += len(x)
            extra.append(x)
        return np.concatenate([ids, *extra]), np.stack([begin, length])

    def encode(self, col: pa.Array) -> list[bytes]:
        texts = [t or "" for t in col.to_pylist()]
        data, off = text_bytes(col)
        starts = np.zeros(len(data) + 1, bool)
        starts[1:] = data == 10
        starts[:-1] |= (data == 10) | (data == 32)
        starts[off] = True
        s = np.flatnonzero(starts)
        s, e = s[:-1], s[1:]
        if len(s):
            h = span_hashes(data, s, e)
            _, some, which = np.unique(h, return_index=True, return_inverse=True)
            if len(self.known) > MEMO:
                self.forget()
            units = [data[a:b].tobytes() for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True)]
            new = [u for u in units if u not in self.known]
            if new:
                ids, (begin, length) = self.words(new)
                self.known.update((u, len(self.begin) + k) for k, u in enumerate(new))
                self.begin, self.length, self.ids = np.append(self.begin, begin + len(self.ids)), np.append(self.length, length), np.append(self.ids, ids)
            place = np.array([self.known[x] for x in units], np.int64)[which]
            n = self.length[place]
            total = np.concatenate([[0], np.cumsum(n)])
            laid = self.ids[np.repeat(self.begin[place] - total[:-1], n) + np.arange(total[-1])]
            bounds = total[np.searchsorted(s, off)].tolist()
        else:
            laid, bounds = np.zeros(0, "<u4"), [0] * len(off)
        space = _SPACE[data]
        doubt = np.flatnonzero((space[:-1] & space[1:]) | _WIDE[data[:-1]])
        doubt = np.diff(np.searchsorted(doubt, off)) > 0
        special = SPECIAL.encode() in data.tobytes()
        return [(self.whole(t) if (d and _TWO_SPACES.search(t)) or (special and SPECIAL in t) else laid[a:b]).tobytes() for t, d, a, b in zip(texts, doubt.tolist(), bounds[:-1], bounds[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or tokenizer_path())
        for batch in pieces(batches, "text", 1 << 20):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids += END
                n = len(ids) // 4
                ends = list(range(n, 0, -capacity))[::-1]
                start = 0
                for k, end in enumerate(ends):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(end - start)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * end]))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))], names=list(out))

    return only(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, PIECES)


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``lengths``."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The best lower bound for ``count[n]`` pieces of each length n: volume, and two families of dual-feasible functions."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    have = np.flatnonzero(count)
    # U_eps: sizes over capacity - e count as a whole bin, those under e as nothing.
    for e in np.unique(np.r_[have[have <= capacity // 2], capacity - have[have > capacity // 2]]):
        if 0 < e <= capacity // 2:
            mass = int(count[capacity - e + 1 :].sum()) * capacity + int((count * size)[e : capacity - e + 1].sum())
            best = max(best, -(-mass // capacity))
    # u_k: x stays where (k + 1) x is whole, else its step of 1/k.
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins; a bit set finds the tightest bin that fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
        else:
            b, left, used = used, capacity, used + 1
        bins[i], offset[i] = b, capacity - left
        rest = left - n
        if rest:
            if not free[rest]:
                mask |= 1 << rest
            free[rest].append(b)
    return bins, offset, used


def _packer(capacity: int, base: int, last: bool):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy()
        bins, offset, used = best_fit_decreasing(lengths, capacity)
        full = np.bincount(bins, weights=lengths, minlength=used)
        gap = used - dual_feasible_bound(lengths, capacity)
        loose = np.zeros(used, bool)
        if gap > 0 and not last:  # exchange the emptiest bins: those that hold the gap's free room
            worst = np.argsort(full, kind="stable")
            room = np.cumsum(capacity - full[worst])
            loose[worst[: int(np.searchsorted(room, 2 * gap * capacity)) + 1]] = True
            loose &= full < capacity
        part = part.drop(columns=["deal", "g"])
        part["sequence_id"] = base + (int(key[0]) << 28) + bins
        part["offset"] = offset
        part["open"] = loose[bins]
        return part

    return run


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000, rounds: int = 3) -> DataFrame:
    """Give each piece of ``pieces_df`` a sequence_id and an offset.

    ``pieces_df`` must be stable (written or checkpointed): its rows are dealt by their place in it.
    """
    spark = pieces_df.sparkSession
    todo = pieces_df.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    schema = PACKED + ", open boolean"
    done: list[DataFrame] = []
    for k in range(rounds + 1):
        rows = todo.count()
        if not rows:
            break
        # The last round still has partitions, whose gaps are then at most a bin each.
        groups = max(1, -(-rows // group_rows))
        last = k == rounds or groups == 1
        packed = cut(todo.withColumn("g", F.pmod("deal", F.lit(groups))).groupBy("g").applyInPandas(_packer(capacity, k << 56, last), schema))
        done.append(packed.filter(~F.col("open")).drop("open"))
        todo = packed.filter("open").drop("open", "sequence_id", "offset").withColumn("deal", F.xxhash64(F.monotonically_increasing_id(), F.lit(k)))
    if not done:
        return spark.createDataFrame([], PACKED)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (sequences, bound): the sequences of a packing, and a lower bound on those of any packing of its pieces.

    The driver gets the number of pieces of each length, ``capacity`` rows at most.
    """
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[r["length"]] = r["n"]
    return packed.agg(F.countDistinct("sequence_id").alias("sequences")).withColumn("bound", F.lit(bound_of_counts(count, capacity)).cast("long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_rows: int = 20_000) -> DataFrame:
    return pack(cut(token_pieces(docs, capacity, path)), capacity, group_rows)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
