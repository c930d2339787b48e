"""Conversation structure repair by signatures (operator 12).

A conversation's rows, in the order of their turns, become a signature: one letter a row, which tells the
initial of its role and its first fault.  Conversations share signatures, and each distinct one is solved
once: recursion over its suffixes, memoised by a row's letter and the costs to go from the four states of
the grammar ``(s?(ua)+)?``, gives the cheapest edits, least in ASCII order.  The audits are joined back to
the conversations and their edits are replayed on the texts.

A conversation of any length is no group of one task.  Rows are sorted into ranges of (conversation, turn,
row), so a long one lies in several partitions.  Each partition makes a piece of the signature; pieces
exchange only digests, for rows that repeat one of an earlier piece.  The pieces' letters are joined, and
after solving each piece gets its share of the edits.  What has to pass through one task is what a
SHA-256 of a whole conversation and an audit string ask for: one letter a row, and the repaired text of a
conversation in fragments, as a stream.

``damaged`` makes the test rows of the query; ``repair`` takes any conversations.

Defined cases: a null role or text is one space, a null turn is least, a null conv_id is a conversation of
its own; turns that tie are in order of role and text (of the first 16 and 64 characters, then of a hash);
a row that stands twice is a duplicate; a gap beyond the longs is null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import WORD_SEP, cut, only, pieces, table

#: Classes of a row's role by its initial, and its faults; a letter of a signature is 97 + 4 * class + fault.
ROLES = "sua"
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States: nothing so far, after the system row, after a user row, after an assistant row.  What may be inserted or rerolled to leads from each to one state.
NEXT = (2, 2, 3, 2)
NAMES = ("", "system", "user", "assistant")
RETRY, REMOVE, ADD, UNMENDED = 2, 3, 2, 1
#: Edits that end a conversation in each state, and their costs.
CLOSING = ("", "II", "I", "")
#: Audits of up to so many bytes are sent to every task; more are joined by a shuffle.
SENT_BYTES = 16 << 20
#: Bytes of a fragment of a repaired text.
FRAGMENT = 1 << 18
LEGAL = {(0, 1), (1, 2), (2, 1)}


@functools.cache
def _step(letter: str, togo: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The costs to go before a row, given those after it: their least, what each state is above it, and the row's edits and next state from each state."""
    role, fault = divmod(ord(letter) - 97, 4)
    best: list[tuple[int, str, int]] = []
    for state in range(4):
        ways = [(REMOVE + togo[state], "D", state)]
        if fault in (CLEAN, TRUNCATED):
            left = UNMENDED if fault == TRUNCATED else 0
            to = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(role)
            if to is not None:
                ways.append((left + togo[to], "K", to))
            ways.append((RETRY + left + togo[NEXT[state]], "R", NEXT[state]))
        best.append(min(ways))
    while True:
        new = [min(best[s], (ADD + best[NEXT[s]][0], "I", NEXT[s])) for s in range(4)]
        if new == best:
            break
        best = new
    edits = []
    for state in range(4):
        done, at = "", state
        while not done or done[-1] == "I":
            _, edit, at = best[at]
            done += edit
        edits.append((done, at))
    least = min(b[0] for b in best)
    return least, tuple(b[0] - least for b in best), tuple(edits)


def cheapest_edits(signature: str) -> tuple[int, str]:
    """Least cost, and the edits' initials; the recursion is unrolled from the last row, so that signatures of any length need no stack."""
    togo, cost, rows = tuple(ADD * len(x) for x in CLOSING), 0, []
    for letter in reversed(signature):
        least, togo, edits = _step(letter, togo)
        cost += least
        rows.append(edits)
    state, audit = 0, []
    for edits in reversed(rows):
        done, state = edits[state]
        audit.append(done)
    return cost + togo[0], "".join(audit) + CLOSING[state]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of ``conv_id:turn`` names; nulls are one space there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = only(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    rows = rows.withColumns({"role": space("role"), "text": space("text"), "code": F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20})
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("code <> 0").select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(conv_id: str = "conv_id") -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, row), with their partition, place, role's class and own fault."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(_key().alias("c"), "turn", space("role").alias("role"), space("text").alias("text"))
    bare = F.rtrim("text", F.lit(WORD_SEP))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    role = F.position(F.substring("role", 1, 1), F.lit(ROLES))
    # An empty role's initial would be found at place 1.
    role = F.when((F.col("role") == "") | (role == 0), len(ROLES)).otherwise(role - 1)
    rows = rows.withColumns({"kind": role.cast("int"), "fault": fault.cast("int"), "h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role"), "id": F.monotonically_increasing_id()})
    order = rows.withColumns({"r": F.substring("role", 1, 16), "t": F.substring("text", 1, 64)}).repartitionByRange("c", "turn", "r", "t", "h", "id").sortWithinPartitions("c", "turn", "r", "t", "h", "id").drop("r", "t", "id")
    return cut(order).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})


PIECE = "c string, part int, letters string, lo long, hi long, turns long, digests binary"
_DIGEST = np.dtype([("h", "<i8"), ("g", "<i8"), ("at", "<i8")])


def _pieces(rows: DataFrame) -> DataFrame:
    """A row of ``PIECE`` for each conversation of each partition; digests only of the first and last one, which others may continue."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    columns = ["c", "part", "turn", "kind", "fault", "h", "g"]

    def made(rows: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        """Of whole conversations of this partition."""
        c = rows.column("c").combine_chunks()
        new = np.ones(len(c), bool)
        new[1:] = np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        start = np.flatnonzero(new)
        size, conv = np.diff(np.append(start, len(c))), np.cumsum(new) - 1
        kind, fault, h, g = (np.asarray(rows.column(x)) for x in ("kind", "fault", "h", "g"))
        fault = fault.copy()
        order = np.lexsort((g, h, conv))
        again = np.zeros(len(c), bool)
        again[order[1:]] = (conv[order[1:]] == conv[order[:-1]]) & (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        fault[again & (fault != BLANK)] = DUPLICATE
        letters = (97 + 4 * kind + fault).astype(np.uint8).tobytes().decode()
        turn = rows.column("turn").combine_chunks()
        known, value = np.asarray(turn.is_valid()), np.asarray(turn.fill_null(0))
        changed = known.copy()
        changed[1:] &= new[1:] | ~known[:-1] | (value[1:] != value[:-1])
        some = np.logical_or.reduceat(known, start)
        lo = np.minimum.reduceat(np.where(known, value, np.iinfo(np.int64).max), start)
        hi = np.maximum.reduceat(np.where(known, value, np.iinfo(np.int64).min), start)
        digests = [None] * len(start)
        for k in {*([0] if first else []), *([len(start) - 1] if last else [])}:
            mine = np.arange(start[k], start[k] + size[k])
            mine = mine[(fault[mine] == CLEAN) | (fault[mine] == TRUNCATED)]
            out = np.zeros(len(mine), _DIGEST)
            out["h"], out["g"], out["at"] = h[mine], g[mine], mine - start[k]
            digests[k] = out.tobytes()
        text = [letters[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([c.take(pa.array(start)), rows.column("part").combine_chunks().take(pa.array(start)), pa.array(text, pa.string()), pa.array(lo, mask=~some), pa.array(hi, mask=~some), pa.array(np.add.reduceat(changed, start, dtype=np.int64)), pa.array(digests, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], True  # rows of the last conversation so far
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c")
            last = c[batch.num_rows - 1]
            before = int(pc.sum(pc.not_equal(c, last)).as_py())  # sorted: the last conversation's rows stand at the end
            if before or (held and held[-1].column("c")[0] != last):
                yield made(pa.Table.from_batches([*held, *([batch.slice(0, before)] if before else [])]), first, False)
                first, held = False, []
            held.append(batch.slice(before))
        if held:
            yield made(pa.Table.from_batches(held), first, True)

    return rows.select(*columns).mapInArrow(run, PIECE)


def _mark_repeats(found: DataFrame) -> DataFrame:
    """``found`` with the letters of rows that repeat one of an earlier piece of their conversation changed to duplicates."""
    shared = cut(found.filter("digests IS NOT NULL").groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c"))  # at most one a partition
    if shared.isEmpty():
        return found.drop("digests")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, part, raw in zip(*(batch.column(x).to_pylist() for x in ("c", "part", "digests")), strict=True):
                d = np.frombuffer(raw, _DIGEST)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(d), pa.string()), pa.array(np.full(len(d), part, np.int32)), pa.array(d["at"]), pa.array(d["h"]), pa.array(d["g"])], names=["c", "part", "at", "h", "g"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for letters, again in zip(batch.column("letters").to_pylist(), batch.column("again").to_pylist(), strict=True):
                if again:
                    raw = np.frombuffer(letters.encode(), np.uint8).copy()
                    raw[again] = 97 + (raw[again] - 97) // 4 * 4 + DUPLICATE
                    letters = raw.tobytes().decode()
                text.append(letters)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("c", "part")), pa.array(text, pa.string()), *(batch.column(x) for x in ("lo", "hi", "turns"))], names=["c", "part", "letters", "lo", "hi", "turns"])

    each = found.filter("digests IS NOT NULL").join(F.broadcast(shared), "c", "left_semi").select("c", "part", "digests").mapInArrow(rows_of, "c string, part int, at long, h long, g long")
    least = each.groupBy("c", "h", "g").agg(F.min("part").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = each.join(least, ["c", "h", "g"]).filter("part > first").groupBy("c", "part").agg(F.collect_list("at").alias("again"))  # of one piece: a partition's rows at most
    return found.drop("digests").join(again, ["c", "part"], "left").mapInArrow(mark, PIECE.rpartition(",")[0])


def _conversations(found: DataFrame) -> DataFrame:
    """c, signature, gaps and the sizes of the pieces (part, n), in order."""
    per = found.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "lo", "hi", "turns"))).alias("p"))
    lo, hi = F.array_min(F.transform("p", lambda x: x["lo"])), F.array_max(F.transform("p", lambda x: x["hi"]))
    # A turn on both sides of a border counts once.
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("hi"))
    turns = F.aggregate("p", zero, lambda acc, x: F.struct((acc["n"] + x["turns"] - F.when(acc["hi"] == x["lo"], 1).otherwise(0)).alias("n"), F.coalesce(x["hi"], acc["hi"]).alias("hi")))["n"]
    gaps = F.when(hi.isNull(), F.lit(0).cast("long")).otherwise(F.try_subtract(F.try_add(F.try_subtract(hi, lo), F.lit(1).cast("long")), turns))
    return per.select("c", F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("signature"), gaps.alias("gaps"), F.transform("p", lambda x: F.struct(x["part"].alias("part"), F.length(x["letters"]).alias("n"))).alias("sizes"))


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solve(signatures: DataFrame) -> DataFrame:
    """A row of ``SOLVED`` for each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.column("signature").to_pylist():
                faults = [sum(s.count(chr(97 + 4 * k + f)) for k in range(len(ROLES) + 1)) for f in (BLANK, DUPLICATE, TRUNCATED)]
                kind = [(ord(x) - 97) // 4 for x in s]
                rows.append((s, *faults, sum(x not in LEGAL for x in zip(kind, kind[1:])), *cheapest_edits(s)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k in (0, 6) else pa.int64()) for k, x in enumerate(cols)], names=[x.split()[0] for x in SOLVED.split(", ")])

    return signatures.select("signature").distinct().mapInArrow(run, SOLVED)


_EDITS = re.compile("I*[DKR]")


def _shares(audits: DataFrame) -> DataFrame:
    """c, part, the edits of the piece's rows, the state before them, whether the piece is the conversation, and whether it is its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, signature, sizes, audit in zip(*(batch.column(x).to_pylist() for x in ("c", "signature", "sizes", "audit")), strict=True):
                edits = np.frombuffer(audit.encode(), np.uint8)
                ends = np.append(0, np.flatnonzero(edits != ord("I")) + 1)
                outputs = np.append(0, np.cumsum(edits != ord("D")))
                head = audit.lstrip("D")
                system = head[:1] == "K" and signature[len(audit) - len(head)] < "e"
                at = 0
                for k, p in enumerate(sizes):
                    start, at = int(ends[at]), at + p["n"]
                    end = int(ends[at]) if k + 1 < len(sizes) else len(audit)
                    n = int(outputs[start])
                    out.append((c, p["part"], audit[start:end], 0 if n == 0 else (1 if n == 1 else 2 + n % 2) if system else 3 - n % 2, len(sizes) == 1))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["c", "part", "edits", "state", "alone"])

    return audits.select("c", "signature", "sizes", "audit").mapInArrow(run, "c string, part int, edits string, state int, alone boolean")


REPLAYED = "c string, part int, k long, sha string, fragment binary"


def _replay(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """The hash of each conversation that is one piece; else its repaired text in fragments, in the order of (part, k)."""
    names = [x.split()[0] for x in REPLAYED.split(", ")]
    both = shares.select("c", "part", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits", "state", "alone")
    both = both.unionByName(rows.select("c", "part", "seq", "role", "text"), allowMissingColumns=True).repartition("c", "part").sortWithinPartitions("c", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = part = edits = None
        at = state = k = 0
        alone, digest, text = True, hashlib.sha256(), bytearray()
        out: list[tuple] = []

        def put(role: str, words: str) -> None:
            nonlocal text, k
            text += f"{role}:{words}".encode() if before == 0 else f"\n{role}:{words}".encode()
            if len(text) >= FRAGMENT:
                if alone:
                    digest.update(text)
                else:
                    out.append((c, part, k, None, bytes(text)))
                    k += 1
                text = bytearray()

        def leave() -> None:
            """What is inserted after the last row, and the piece's end."""
            nonlocal state, before
            if c is None:
                return
            for _ in edits[at:]:
                state = NEXT[state]
                put(NAMES[state], "")
                before = 1
            if alone:
                digest.update(text)
                out.append((c, part, 0, digest.hexdigest(), None))
            elif text:
                out.append((c, part, k, None, bytes(text)))

        before = 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=names)

        for batch in pieces(batches, "text", 1 << 20):
            for key, piece, seq, role, words, share, start, whole in zip(*(batch.column(x).to_pylist() for x in ("c", "part", "seq", "role", "text", "edits", "state", "alone")), strict=True):
                if seq < 0:
                    leave()
                    c, part, edits, at, state, alone, k = key, piece, share, 0, start, whole, 0
                    digest, text, before = hashlib.sha256(), bytearray(), int(start > 0)
                    continue
                mine = _EDITS.match(edits, at)[0]
                at += len(mine)
                for edit in mine:
                    if edit == "D":
                        continue
                    if edit == "K":
                        state = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
                        put(role, words)
                    else:
                        state = NEXT[state]
                        put(NAMES[state], words if edit == "R" else "")
                    before = 1
            yield batch_of()
            out.clear()
        leave()
        yield batch_of()

    return both.mapInArrow(run, REPLAYED)


def _joined_hashes(fragments: DataFrame) -> DataFrame:
    """(c, sha) of conversations in fragments: a stream of bytes, as SHA-256 wants them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, digest = None, hashlib.sha256()
        for batch in pieces(batches, "fragment"):
            done = []
            for key, raw in zip(batch.column("c").to_pylist(), batch.column("fragment"), strict=True):
                if key != c:
                    if c is not None:
                        done.append((c, digest.hexdigest()))
                    c, digest = key, hashlib.sha256()
                digest.update(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], names=["c", "sha"])
        if c is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([digest.hexdigest()])], names=["c", "sha"])

    return fragments.select("c", "part", "k", "fragment").repartition("c").sortWithinPartitions("c", "part", "k").mapInArrow(run, "c string, sha string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``."""
    rows = _sorted(only(rows, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}))
    per = cut(_conversations(_mark_repeats(cut(_pieces(rows)))))
    solved = cut(solve(per))
    size = solved.agg(F.sum(F.length("signature") + F.length("audit") + 100)).first()[0] or 0
    audits = cut(per.join(F.broadcast(solved) if size <= SENT_BYTES else solved, "signature"))
    replayed = cut(_replay(rows, _shares(audits)))
    shas = replayed.filter("sha IS NOT NULL").select("c", "sha").union(_joined_hashes(replayed.filter("fragment IS NOT NULL")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = audits.select("c", *counts, "audit").unionByName(shas, allowMissingColumns=True)
    # All rows of a conversation in several pieces may be deleted: then no fragment has come.
    out = both.groupBy("c").agg(*[F.max(x).alias(x) for x in counts], F.max("audit").alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return out.select(F.when(F.col("c") != "", F.col("c")).cast("long").alias("conv_id"), *counts, "audit", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    mended = repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(_key().alias("c"))
    both = mended.withColumn("c", _key()).drop("conv_id").unionByName(all_, allowMissingColumns=True).groupBy("c").agg(*[F.max(x).alias(x) for x in (*counts, "audit", "repaired_sha256")], F.max(F.col("audit").isNotNull()).alias("some"))
    # Of a gap beyond the longs nothing is known; without rows there is none.
    known = [F.when(F.col("some"), F.col(x)).otherwise(F.lit(0).cast("long")).alias(x) for x in counts]
    return both.select(F.when(F.col("c") != "", F.col("c")).cast("long").alias("conv_id"), *known, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
