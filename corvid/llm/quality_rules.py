"""Line-first quality rules (operator 3).

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed;
a document is rejected when its base counts fail or when it loses more than ``max_lost`` of its word
characters.  All counting is done by numpy over Arrow batches of whole texts.

Defined cases: a null or empty text has no words and fails; ``\\r`` counts as white space inside a
line; repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import mix, only, pieces, span_hashes, table, text_bytes, window_hashes, words_of

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, n_lines long, n_failed_lines long"
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST = 0.5
#: Phrases of lines that a page's frame, not its author, puts there.
BOILERPLATE = [
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "all rights reserved",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "terms of use",
    "terms of service",
    "click here",
    "read more",
    "sign up",
    "subscribe to our newsletter",
]
_PHRASE = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE), re.IGNORECASE)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _PIPE, _STOP, _BANG = _mask(b"#*$%&|<>"), _mask(b"|"), _mask(b".!?:;"), _mask(b"!?")
_SYMBOL_LINE = _mask(b"#*$%&<>^~=@\\{}[]_")
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_UPPER, _LOWER = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123)))


def _counts(mask: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    run = np.zeros(len(data) + 1, np.int32)
    np.cumsum(mask[data], out=run[1:])
    return (run[end] - run[start]).astype(np.int64)


def line_failures(lines: dict[str, np.ndarray]) -> np.ndarray:
    """True for lines to remove.  ``lines`` has the counts per line that ``judge`` makes."""
    words, chars = lines["words"], np.maximum(lines["chars"], 1)
    navigation = (lines["pipes"] >= 3) & (lines["pipes"] * 4 >= words)
    punctuation = (lines["symbols"] * 5 > chars) | ((words >= 5) & (lines["bangs"] * 2 > words)) | ((words >= 10) & (lines["stops"] == 0) & (lines["pipes"] == 0))
    shouted = (words >= 8) & (lines["upper"] > 4 * lines["lower"]) & (lines["bangs"] > 0)
    repeated = (words >= 10) & (lines["distinct"] * 10 < words * 3)
    return navigation | punctuation | shouted | repeated | (lines["phrase"] > 0) | lines["again"]


def judge(data: np.ndarray, off: np.ndarray, max_lost: float = MAX_LOST) -> dict[str, np.ndarray]:
    """The counts and verdicts of texts laid end to end as bytes; see ``COLUMNS``."""
    n = len(off) - 1
    row = np.arange(n)
    per_row = lambda rows, w=None: np.bincount(rows, weights=w, minlength=n).astype(np.int64)
    s, e, doc = words_of(data, off)
    n_words = per_row(doc)
    head = _counts(_HEAD, data, s, e)
    word_chars = per_row(doc, head)
    h = span_hashes(data, s, e)
    # Words in 3-word windows that stand at least twice in their text.
    repeat = np.zeros(len(s), bool)
    if len(s) >= 3:
        w = window_hashes(h, 3)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        key = w[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        for k in range(3):
            repeat[twice + k] = True
    # Lines.
    feeds = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([off[:-1], feeds + 1]))
    ls = ls[ls < len(data)]
    le = np.append(ls[1:], len(data))
    # A line ends at its feed, which may be the last byte before the next line.
    ended = (le > ls) & (data[le - 1] == 10) if len(le) else np.zeros(0, bool)
    le = le - ended
    line_of = np.searchsorted(ls, s, side="right") - 1
    lines = {"words": np.bincount(line_of, minlength=len(ls)), "chars": np.bincount(line_of, weights=head, minlength=len(ls)).astype(np.int64)}
    ldoc = np.searchsorted(off, ls, side="right") - 1
    for name, mask in (("pipes", _PIPE), ("stops", _STOP), ("bangs", _BANG), ("symbols", _SYMBOL_LINE), ("upper", _UPPER), ("lower", _LOWER)):
        lines[name] = _counts(mask, data, ls, le)
    key = h ^ mix(line_of.astype(np.uint64) + np.uint64(7))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    lines["distinct"] = np.bincount(line_of[fresh], minlength=len(ls))
    text_line = np.flatnonzero(lines["words"] > 0)
    key = span_hashes(data, ls[text_line], le[text_line]) ^ mix(ldoc[text_line].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(ls), bool)
    again[text_line[order[1:]]] = key[order[1:]] == key[order[:-1]]
    lines["again"] = again
    lines["phrase"] = np.zeros(len(ls), np.int64)
    raw, bounds = data.tobytes(), off.tolist()
    found = np.fromiter((m.start() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in _PHRASE.finditer(raw, a, b)), np.int64)
    if len(found):
        lines["phrase"][np.searchsorted(ls, found, side="right") - 1] = 1
    failed = line_failures(lines) & (lines["words"] > 0)
    lost = per_row(ldoc[failed], lines["chars"][failed])
    n_repeat = per_row(doc[repeat])
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    n_symbols = _counts(_SYMBOL, data, off[:-1], off[1:])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": per_row(ldoc[again]), "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (lost <= max_lost * word_chars), "lost_chars": lost, "n_lines": per_row(ldoc[text_line]), "n_failed_lines": per_row(ldoc[failed]),
        "row": row, "line_start": ls, "line_end": le, "line_failed": failed, "line_row": ldoc,
    }


def quality(docs: DataFrame, max_lost: float = MAX_LOST, with_text: bool = False) -> DataFrame:
    """Counts and verdict for each row of docs(doc_id, text); ``with_text`` adds the cleaned text."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, off = text_bytes(batch.column("text"))
            got = judge(data, off, max_lost)
            cols = [batch.column("doc_id"), *(pa.array(got[c]) for c in names[1:])]
            if with_text:
                keep = [[] for _ in range(len(off) - 1)]
                for a, b, bad, d in zip(got["line_start"], got["line_end"], got["line_failed"], got["line_row"], strict=True):
                    if not bad:
                        keep[d].append(data[a:b].tobytes().decode("utf-8"))
                cols.append(pa.array(["\n".join(x) for x in keep]))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["clean_text"] * with_text)

    return only(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, COLUMNS + ", clean_text string" * with_text)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
