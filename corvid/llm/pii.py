"""Personal data by patterns and a character BiLSTM-CRF (operator 1).

The base spans are the contract's patterns.  A character-level bidirectional LSTM with CRF
transitions, trained here in numpy from labelled spans, adds spans that the patterns miss (spelled-out
addresses, numbers without a country code, other separators).  A span of these kinds holds a digit,
an ``@`` or a bracketed ``at``; the texts around such characters are cut into overlapping windows,
every window is decoded, and so is every run of adjacent windows, as one sequence over their averaged
scores; a run that ends inside a span grows until it doesn't, so a span can have any length, and an
address is taken whole.  The spans of a document are reconciled together: of conflicting spans the
set with the largest total margin wins, found by weighted interval scheduling over the whole
document.  An added span must pass its kind's check (digit counts, Luhn, octets, an address once
spelled back) and may not touch a base span; base spans always stay.

Defined cases: null and empty texts have no spans; positions are code points; repeated rows are
judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import bound_batches, only, pieces, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
# The contract's patterns.  Possessive digits and the look-behind keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, kinds as listed, then by start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- the tagger ---------------------------------------------------------------------------------

#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WIDTH, STEP = 64, 32
HIDDEN = 16
#: Labelled windows that the tagger is fitted on, and its passes over them.
FIT_WINDOWS, PASSES, BATCH = 3072, 6, 80
_CLASSES = "abcdefghijklmnopqrstuvwxyz@.,-_+%()[]{}/:;\"'=|! \n"
OTHER, DIGIT, PAD = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
VOCAB = PAD + 1
_TABLE = np.full(0x250, OTHER, np.int8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[ord(_c)] = _k
    _TABLE[ord(_c.upper())] = _k
_TABLE[48:58] = DIGIT


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], OTHER)


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented prose with spans of each kind, plain and disguised, and their tags."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    syl = ["an", "er", "th", "la", "que", "ch", "on", "re", "ti", "st", "é", "ü", "de", "ción", "ou", "en"]
    word = lambda: "".join(pick(syl) for _ in range(int(rng.integers(1, 4))))

    def entity() -> tuple[int, str]:
        k = int(rng.integers(0, 9))
        if k < 3:
            local = pick([word, lambda: word() + pick(". _-".replace(" ", "")) + word(), lambda: word() + num(2), lambda: "." + num(2)])()
            at = pick(["@", "@", " (at) ", "(at)", " [at] ", " @ "])
            dot = pick([".", " (dot) ", "[dot]", " [dot] ", "(dot)"]) if at.strip() != "@" else "."
            return 0, at.join([local, dot.join([word() + pick(["", num(1)]), pick(["example", word()]), pick(["com", "org", "net", "de"])])])
        if k < 5:
            return 1, pick([".", ".", "[.]", " . "]).join(str(x) for x in rng.integers(0, 256, 4))
        if k < 7:
            d = num(15)
            d += next(str(c) for c in range(10) if luhn(d + str(c)))
            s = pick(["", " ", "-", ".", "/", "  "])
            return 2, s.join([d[i : i + 4] for i in range(0, 16, 4)])
        return 3, pick([lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(6)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"])()

    def decoy() -> str:
        return pick([lambda: num(int(rng.integers(1, 9))), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(30))}"', lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(1)},{num(3)}"])()

    x, y = np.full((n, WIDTH), PAD, np.int64), np.zeros((n, WIDTH), np.int64)
    for i in range(n):
        text, tags = "", []
        while len(text) < 2 * WIDTH:
            r = rng.random()
            if r < 0.16:
                kind, s = entity()
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = decoy() if r < 0.24 else word() + pick(["", "", "", ".", ","])
                tags += [0] * len(s)
            text += s + " "
            tags.append(0)
        at = int(rng.integers(0, len(text) - WIDTH))
        x[i], y[i] = encode(text)[at : at + WIDTH], tags[at : at + WIDTH]
        if y[i, 0] and y[i, 0] % 2 == 0:  # an entity that the border cuts begins at the border
            y[i, 0] -= 1
    return x, y


Weights = dict[str, np.ndarray]


def _start(seed: int, hidden: int) -> Weights:
    rng = np.random.default_rng(seed)
    w = {"out": rng.normal(0, 0.1, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    for d in "fb":
        w["in" + d] = rng.normal(0, 0.2, (VOCAB, 4 * hidden))
        w["in" + d][:, hidden : 2 * hidden] += 1.0  # forget gates begin open
        w["rec" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x: np.ndarray, table: np.ndarray, rec: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states, time first: (T, N, H) from class ids (T, N)."""
    hid = rec.shape[0]
    h = c = np.zeros((x.shape[1], hid), np.float32)
    out = np.empty((*x.shape, hid), np.float32)
    for t in range(len(x)):
        g = table[x[t]] + h @ rec
        sig = _sigmoid(g[:, : 3 * hid])
        i, f, o, z = sig[:, :hid], sig[:, hid : 2 * hid], sig[:, 2 * hid :], np.tanh(g[:, 3 * hid :])
        prev_h, prev_c = h, c
        c = f * c + i * z
        tc = np.tanh(c)
        h = out[t] = o * tc
        if keep is not None:
            keep.append((i, f, o, z, prev_c, tc, prev_h))
    return out


def _lstm_back(x: np.ndarray, grad: np.ndarray, rec: np.ndarray, keep: list, d_table: np.ndarray, d_rec: np.ndarray) -> None:
    dh = dc = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, z, prev_c, tc, prev_h = keep[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * z * i * (1 - i), dc * prev_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        np.add.at(d_table, x[t], dg)
        d_rec += prev_h.T @ dg
        dh = dg @ rec.T
        dc = dc * f


def emissions(w: Weights, x: np.ndarray) -> np.ndarray:
    """Tag scores (T, N, TAGS) of windows given as class ids (N, T)."""
    xt = x.T
    h = np.concatenate([_lstm(xt, w["inf"], w["recf"]), _lstm(xt[::-1], w["inb"], w["recb"])[::-1]], axis=2)
    return h @ w["out"] + w["bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    xt, yt = x.T, y.T
    steps, n = xt.shape
    keep_f: list = []
    keep_b: list = []
    h = np.concatenate([_lstm(xt, w["inf"], w["recf"], keep_f), _lstm(xt[::-1], w["inb"], w["recb"], keep_b)[::-1]], axis=2)
    e = h @ w["out"] + w["bias"]
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + w["first"]
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + w["trans"], 1) + e[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _lse(w["trans"] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    at = np.arange(n)
    gold = w["first"][yt[0]] + e[np.arange(steps)[:, None], at, yt].sum(0) + w["trans"][yt[:-1], yt[1:]].sum(0)
    de = np.exp(a + b - z[:, None])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["first"] = de[0].sum(0)
    np.subtract.at(g["first"], yt[0], 1)
    for t in range(1, steps):
        g["trans"] += np.exp(a[t - 1][:, :, None] + w["trans"] + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(g["trans"], (yt[:-1], yt[1:]), 1)
    de[np.arange(steps)[:, None], at, yt] -= 1
    g["out"] = np.einsum("tnh,tnk->hk", h, de)
    g["bias"] = de.sum((0, 1))
    dh = de @ w["out"].T
    hid = w["recf"].shape[0]
    _lstm_back(xt, dh[:, :, :hid], w["recf"], keep_f, g["inf"], g["recf"])
    _lstm_back(xt[::-1], dh[::-1, :, hid:], w["recb"], keep_b, g["inb"], g["recb"])
    return float((z - gold).mean()), {k: v / n for k, v in g.items()}


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, passes: int = PASSES, seed: int = 5) -> Weights:
    """Fit the tagger to labelled windows with Adam."""
    w = _start(seed, hidden)
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    total = passes * -(-len(x) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            _, g = _gradients(w, x[some], y[some])
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for k in w:
                q = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


_FITTED: dict[tuple, Weights] = {}


def tagger(seed: int = 5) -> Weights:
    """The fitted weights; made once in a driver process, the same in every run."""
    if (seed,) not in _FITTED:
        _FITTED[seed,] = train(*labelled_windows(FIT_WINDOWS, seed), seed=seed)
    return _FITTED[seed,]


def _viterbi(w: Weights, e: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tag of each row of ``e``, and its score over that of the outside tag.

    Rows stand by time; at time t the first ``active[t]`` sequences have one each (so longer sequences come first).
    """
    at = np.concatenate([[0], np.cumsum(active)])
    back = np.zeros(e.shape, np.int8)
    s = e[: active[0]] + w["first"]
    for t in range(1, len(active)):
        n = active[t]
        c = s[:n, :, None] + w["trans"]
        back[at[t] : at[t + 1]] = c.argmax(1)
        s[:n] = c.max(1) + e[at[t] : at[t + 1]]
    last, tags = s.argmax(1), np.empty(len(e), np.int64)
    for t in range(len(active) - 1, -1, -1):
        n, on = active[t], active[t + 1] if t + 1 < len(active) else 0
        here = last[:n].copy()
        if on:
            here[:on] = back[at[t + 1] : at[t + 2]][np.arange(on), tags[at[t + 1] : at[t + 2]]]
        tags[at[t] : at[t + 1]] = here
    return tags, np.take_along_axis(e, tags[:, None], 1)[:, 0] - e[:, 0]


def decode(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (N, T) of each window by Viterbi, and each place's score over that of the outside tag."""
    e = emissions(w, x)
    return _windows(w, e)


def _windows(w: Weights, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, n, _ = e.shape
    tags, margin = _viterbi(w, e.reshape(steps * n, TAGS), np.full(steps, n))
    return tags.reshape(steps, n).T, margin.reshape(steps, n).T


# --- windows of documents -----------------------------------------------------------------------

#: What every plausible span holds: the windows without any of it can't give one, and are not decoded.  More than 19 digits in a row are no card's and no part of an address or number.
_GATE = re.compile(r"(?<![0-9])[0-9]{1,19}(?![0-9])|@|[(\[{]\s*at\s*[)\]}]", re.IGNORECASE)
_AT, _DOT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s*@\s*", re.IGNORECASE), re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|" + _DOT.pattern + r")[A-Za-z0-9-]+)*", re.IGNORECASE)
_EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]")
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}")


def window_starts(text: str) -> list[int]:
    """Starts, on a grid of STEP, of the windows that hold a part of a match of ``_GATE``."""
    out: list[int] = []
    for m in _GATE.finditer(text):
        for s in range(m.start() // STEP - 1, (m.end() - 1) // STEP + 1):
            if s >= 0 and (not out or s > out[-1]):
                out.append(s)
    return [s * STEP for s in out]


def plausible(kind: str, text: str) -> bool:
    """Whether an added span can be of its kind."""
    if kind == "email":
        return bool(_EMAIL_WHOLE.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == "ip":
        parts = re.split(r"\s*[(\[{]?\s*\.\s*[)\]}]?\s*", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    d = _digits(text)
    if not _NUMBER.fullmatch(text):
        return False
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
    groups = re.findall(r"[0-9]+", text)
    return 10 <= len(d) <= 15 and len(groups) >= 3 and max(map(len, groups)) <= 8 and not _DATE.fullmatch(text)


def _candidates(text: str, start: int, tags: np.ndarray, margin: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, margin) of the spans of one window or run; those that can't be of their kind are left out."""
    out, t, n = [], 0, min(len(tags), len(text) - start)
    while t < n:
        tag = int(tags[t])
        if not tag:
            t += 1
            continue
        kind, begin = (tag - 1) // 2, t
        t += 1
        while t < n and int(tags[t]) == 2 + 2 * kind:
            t += 1
        a, b = start + begin, start + t
        while a < b and text[a] in " ,;:\n\"'":
            a += 1
        while b > a and text[b - 1] in " ,;:.\n\"'":
            b -= 1
        if kind == 0:
            a, b = whole_address(text, a, b)
        if b > a and plausible(KINDS[kind], text[a:b]):
            out.append((a, b, kind, float(margin[begin:t].sum())))
    return out


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The address around the first at-sign of a span, so that none is cut off; the span itself where it holds none."""
    m = _AT.search(text, a, b)
    host = _HOST.match(text, m.end()) if m else None
    if not host:
        return a, b
    begin = m.start()
    while begin > 0 and text[begin - 1] in _LOCAL:
        begin -= 1
    return begin, host.end()


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of all windows' spans of a document, the set without overlaps that has the largest total margin."""
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, m in found:
        best[a, b, k] = max(m, best.get((a, b, k), 0.0))
    spans = sorted(((a, b, k, m) for (a, b, k), m in best.items()), key=lambda x: (x[1], x[0], x[2]))
    ends = [s[1] for s in spans]
    total, take = [0.0], []
    for i, (a, _, _, m) in enumerate(spans):
        j = bisect.bisect_right(ends, a, 0, i)
        take.append(total[j] + m > total[-1])
        total.append(max(total[-1], total[j] + m))
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            out.append(spans[i - 1])
            i = bisect.bisect_right(ends, spans[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


#: Share of a window's scores in the average, by place: its middle knows both sides.
_SHARE = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)
#: Windows whose runs are decoded together.
RUN_WINDOWS = 4096
#: Runs of more windows than this are decoded in chunks of as many, which share ``SHARED_WINDOWS`` with the next one.
CHUNK, SHARED_WINDOWS = 64, 16


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """(first, number) of the runs of adjacent windows, in steps."""
    out: list[tuple[int, int]] = []
    for s in starts:
        k = s // STEP
        if out and out[-1][0] + out[-1][1] == k:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((k, 1))
    return out


class _Paths(NamedTuple):
    """Decoded runs laid end to end: their tags and margins, where each begins, and the spans that single windows give."""

    runs: list[tuple[int, int, int]]
    place: np.ndarray
    tags: np.ndarray
    margin: np.ndarray
    single: dict[int, list]


def _paths(texts: list[str], runs: list[tuple[int, int, int]], w: Weights, batch: int, own: bool) -> _Paths:
    """Decodes runs (text, first window, number), the longest first."""
    runs = sorted(runs, key=lambda r: (-r[2], r[0], r[1]))
    place = np.concatenate([[0], np.cumsum([(m + 1) * STEP for _, _, m in runs])])
    where = [(r, d, k + j, j) for r, (d, k, m) in enumerate(runs) for j in range(m)]
    total, weight = np.zeros((int(place[-1]), TAGS), np.float32), np.zeros(int(place[-1]), np.float32)
    single: dict[int, list] = {}
    for at in range(0, len(where), batch):
        some = where[at : at + batch]
        x = np.full((len(some), WIDTH), PAD, np.int64)
        for i, (_, d, k, _) in enumerate(some):
            c = encode(texts[d][k * STEP : k * STEP + WIDTH])
            x[i, : len(c)] = c
        e = emissions(w, x)
        for i, (r, _, _, j) in enumerate(some):
            p = int(place[r]) + j * STEP
            total[p : p + WIDTH] += e[:, i] * _SHARE[:, None]
            weight[p : p + WIDTH] += _SHARE
        if own:
            tags, margin = _windows(w, e)
            for i in np.flatnonzero(tags.any(1)).tolist():
                r, d, k, _ = some[i]
                single.setdefault(r, []).extend(_candidates(texts[d], k * STEP, tags[i], margin[i]))
    total /= weight[:, None]
    length = np.diff(place)
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    by_time = np.concatenate([[0], np.cumsum(active)])
    row = np.repeat(np.arange(len(runs)), length)
    to = by_time[np.arange(len(total)) - place[row]] + row
    flat = np.empty_like(total)
    flat[to] = total
    tags, margin = (v[to] for v in _viterbi(w, flat, active))
    return _Paths(runs, place, tags, margin, single)


def _run_spans(text: str, run: tuple[int, int, int], tags: np.ndarray, margin: np.ndarray, single: list, found: dict) -> tuple[int, int, int] | None:
    """Adds a decoded run's spans and those of its windows to ``found``; returns the run grown, if it ends inside a span."""
    d, k, m = run
    n = min(len(tags), len(text) - k * STEP)
    tags, margin = tags[:n], margin[:n]
    spans = _candidates(text, k * STEP, tags, margin) if tags.any() else []
    # A window's span inside a longer one of its run is a part of that.
    begins, parts = [z[0] for z in spans], []
    for c in single:
        z = spans[j - 1] if (j := bisect.bisect_right(begins, c[0])) else None
        if not (z and z[2] == c[2] and c[1] <= z[1] and c[:2] != z[:2]):
            parts.append(c)
    spans += parts
    if spans:
        found.setdefault(d, []).extend(spans)
    left, right = k > 0 and tags[0] > 0, n == (m + 1) * STEP and k * STEP + n < len(text) and tags[-1] > 0
    if not (left or right):
        return None
    more = min(m, CHUNK)
    first = max(0, k - more) if left else k
    return d, first, min(k + m + (more if right else 0), max(1, -(-len(text) // STEP) - 1)) - first


def _decode_runs(texts: list[str], runs: list[tuple[int, int, int]], w: Weights, batch: int, found: dict, own: bool) -> list[tuple[int, int, int]]:
    """Adds the spans of runs to ``found``, those of their windows too if ``own``; returns the runs that end inside a span, grown."""
    out = _paths(texts, runs, w, batch, own)
    grown = (_run_spans(texts[r[0]], r, out.tags[a:b], out.margin[a:b], out.single.get(i, []), found) for i, (r, a, b) in enumerate(zip(out.runs, out.place[:-1].tolist(), out.place[1:].tolist(), strict=True)))
    return [g for g in grown if g]


def _agreed(before: np.ndarray, after: np.ndarray) -> int | None:
    """The place nearest to the middle at which two paths over the same characters agree, away from the ends."""
    same = np.flatnonzero(before[STEP:-STEP] == after[STEP:-STEP])
    return STEP + int(same[np.abs(same + STEP - len(before) // 2).argmin()]) if len(same) else None


def _decode_long(texts: list[str], run: tuple[int, int, int], w: Weights, batch: int, found: dict, own: bool) -> tuple[int, int, int] | None:
    """A long run in chunks that share windows with the next one: each path goes on with the next chunk's where both agree.

    Away from its ends a chunk has the scores of the whole run.  Two chunks that agree nowhere are decoded as one.
    """
    d, k, m = run
    tags, margin, single = np.zeros((m + 1) * STEP, np.int8), np.zeros((m + 1) * STEP, np.float32), []
    step = CHUNK - SHARED_WINDOWS
    chunks = [(d, k + at, min(CHUNK, m - at)) for at in range(0, max(1, m - SHARED_WINDOWS), step)]
    end = begin = 0  # of what is decoded so far, and of its last chunk
    for at in range(0, len(chunks), RUN_WINDOWS // CHUNK):
        out = _paths(texts, chunks[at : at + RUN_WINDOWS // CHUNK], w, batch, own)
        for i in sorted(range(len(out.runs)), key=lambda i: out.runs[i][1]):
            single += out.single.get(i, [])
            a, b = int(out.place[i]), int(out.place[i + 1])
            new_tags, new_margin, start = out.tags[a:b], out.margin[a:b], (out.runs[i][1] - k) * STEP
            cut_at = _agreed(tags[start:end], new_tags[: end - start]) if end else 0
            if cut_at is None:
                both = _paths(texts, [(d, k + begin // STEP, (start - begin) // STEP + out.runs[i][2])], w, batch, False)
                new_tags, new_margin, start = both.tags, both.margin, begin
                # What came before the earlier chunk was joined to it in their common part.
                cut_at = STEP * SHARED_WINDOWS // 2 if begin else 0
            tags[start + cut_at : start + len(new_tags)] = new_tags[cut_at:]
            margin[start + cut_at : start + len(new_tags)] = new_margin[cut_at:]
            begin, end = start, start + len(new_tags)
    return _run_spans(texts[d], run, tags, margin, single, found)


def _tagged(texts: list[str], w: Weights, batch: int) -> dict[int, list[tuple[int, int, int, float]]]:
    """The spans of every text that holds any."""
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    todo = [(d, k, m) for d, t in enumerate(texts) for k, m in _runs(window_starts(t))]
    own = True
    while todo:
        grown = [g for run in todo if run[2] > CHUNK and (g := _decode_long(texts, run, w, batch, found, own))]
        short, part, size = [run for run in todo if run[2] <= CHUNK], [], 0
        for i, run in enumerate(short):
            part.append(run)
            size += run[2]
            if size >= RUN_WINDOWS or i + 1 == len(short):
                grown += _decode_runs(texts, part, w, batch, found, own)
                part, size = [], 0
        todo, own = list(dict.fromkeys(grown)), False
    return found


def all_spans(texts: list[str], w: Weights, batch: int = 512) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans (base and added), by kind and then start."""
    base = [base_spans(t) for t in texts]
    found = _tagged(texts, w, batch)
    out = []
    for d, spans in enumerate(base):
        taken = sorted((a, b) for _, a, b in spans)
        starts = [a for a, _ in taken]
        reach: list[int] = []
        for _, b in taken:
            reach.append(max(b, reach[-1] if reach else 0))
        added = []
        if d in found:
            for a, b, k, _ in reconcile(found[d]):
                j = int(np.searchsorted(starts, b, side="left"))
                inside_word = (a > 0 and texts[d][a - 1].isalnum() and texts[d][a].isalnum()) or (b < len(texts[d]) and texts[d][b].isalnum() and texts[d][b - 1].isalnum())
                if not inside_word and (j == 0 or reach[j - 1] <= a):
                    added.append((KINDS[k], a, b))
        out.append((spans, sorted(spans + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by <KIND>; of overlapping spans the first to begin names the mask."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): counts and digest of the base spans, and all spans."""
    w = weights or tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            got = all_spans([t or "" for t in batch.column("text").to_pylist()], w)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in got], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([_joined(s) for _, s in got], pa.string()), pa.array([len(s) for _, s in got], pa.int64())], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return only(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, COLUMNS)


def mask_pii(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The rows of ``docs`` with masked texts; n_chars, where there is one, follows the new text; a null text stays null."""
    bound_batches(docs.sparkSession)
    w, names = weights or tagger(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            new = [None if t is None else mask(t, s) for t, (_, s) in zip(texts, all_spans([t or "" for t in texts], w), strict=True)]
            cols = {c: batch.column(k) for k, c in enumerate(names)}
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if t == old else len(t) for t, old, n in zip(new, texts, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
