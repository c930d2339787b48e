"""Tool-call linking and canonical chat JSON (operator 4).

A turn whose text is a JSON object with ``tool_calls`` (a list of {id, name, arguments}) makes calls; a
turn of role ``tool`` whose text is an object with ``tool_call_id`` is a result; every other turn is a
message.  Arguments that are {"$ref": id} depend on the result of another call.  Calls and results
meet by a hash join on conversation and identifier; a call comes after the results it refers to and a
result after its call, found by rounds over the references that are still open; arguments are
validated against the tool's JSON schema; each item is serialised as canonical JSON (sorted keys, no
spaces, shortest escapes; a surrogate without its partner stays an escape).

One row per item, so that a conversation of any length is never gathered in one task; ``order_turn,
order_level, turn, item`` order a conversation.

Defined cases: null texts are empty contents; a null role is the role "user"; null ids never link;
texts that are not such JSON (NaN, infinities and numbers that overflow are not JSON) are messages; a result without a call, a call without a result, a second
call with a used identifier and a cycle of references are each named in ``status``; of calls with one
identifier the first by turn, place in the turn and JSON is linked, and of rows alike in all of these one
is the call and the others are duplicates; results may repeat; rows whose turns tie keep their places; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import cut, only, pieces, table

#: JSON schemas of the arguments of each tool (see ``fits``).  Tools that are not listed are not validated.
Schema = dict[str, Any]
DEFAULT_SCHEMAS: dict[str, Schema] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "minLength": 1}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}
_TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}
_SURROGATE = re.compile("[\ud800-\udfff]")
ITEMS = "conv_id long, turn long, item int, role string, kind string, call_id string, refs array<string>, valid boolean, json string"


def _escaped(text: str) -> str:
    """Surrogates without a partner, which UTF-8 can't hold, as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return _escaped(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def references(value: Any) -> list[str]:
    """Identifiers that the arguments refer to, in order of keys."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                out.append(v["$ref"])
            else:
                todo += [v[k] for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            todo += v[::-1]
    return list(dict.fromkeys(out))


def fits(value: Any, schema: Schema) -> bool:
    """Whether a value meets a JSON schema: type, enum, const, properties, required, additionalProperties, items, and bounds of numbers and lengths.

    A reference to another call's result stands for a value that is not known yet and fits everywhere.
    """
    if isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str):
        return True
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return False
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(fits(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", [])):
            return False
        return all(fits(x, known[k]) if k in known else more is not False and fits(x, more if isinstance(more, dict) else {}) for k, x in value.items())
    return True


def valid_arguments(name: str, arguments: Any, schemas: dict[str, Schema]) -> bool:
    return isinstance(arguments, dict) and fits(arguments, schemas.get(name, {}))


def _constant(name: str) -> None:
    raise ValueError(name)


def _finite(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError(text)
    return x


def _object(text: str) -> dict | None:
    if not text.lstrip()[:1] == "{":
        return None
    try:
        v = json.loads(text, parse_constant=_constant, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def items_of(role: str | None, text: str | None, schemas: dict[str, Schema]) -> list[tuple]:
    """(role, kind, call_id, refs, valid, json) of one turn."""
    role, text = role or "user", text or ""
    try:
        return _items(role, text, _object(text), schemas)
    except RecursionError:  # nested too deeply to be written again
        return _items(role, text, None, schemas)


def _items(role: str, text: str, v: dict | None, schemas: dict[str, Schema]) -> list[tuple]:
    if v is not None and role == "tool" and isinstance(v.get("tool_call_id"), str):
        return [(role, "result", _escaped(v["tool_call_id"]), [], None, canonical({"content": v.get("content"), "role": role, "tool_call_id": v["tool_call_id"]}))]
    calls = v.get("tool_calls") if v is not None else None
    if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        out = []
        if v.get("content"):
            out.append((role, "message", None, [], None, canonical({"content": v["content"], "role": role})))
        for c in calls:
            args = c.get("arguments")
            if isinstance(args, str):
                args = _object(args) if _object(args) is not None else args
            name = str(c.get("name"))
            out.append((role, "call", _escaped(c["id"]), [_escaped(x) for x in references(args)], valid_arguments(name, args, schemas), canonical({"arguments": args, "id": c["id"], "name": name, "role": role})))
        return out
    return [(role, "message", None, [], None, canonical({"content": text, "role": role}))]


def format_chats(conversations: DataFrame, schemas: dict[str, Schema] | None = None) -> DataFrame:
    schemas = DEFAULT_SCHEMAS if schemas is None else schemas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
        for batch in pieces(batches, "text", 4 << 20):
            rows = [(c, t, k, *x) for c, t, r, s in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True) for k, x in enumerate(items_of(r, s, schemas))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in ITEMS.split(", ")])

    items = only(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}).mapInArrow(run, ITEMS)
    # Rows that are alike in everything are told apart by a number; the first of all that share an identifier is the call.
    linked = cut(items.filter("kind <> 'message'").withColumn("row", F.monotonically_increasing_id()))
    place = F.struct("turn", "item", "json", "row")
    calls = linked.filter("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(place).alias("first"), F.count("*").alias("n_calls"), F.min_by("refs", place).alias("refs"))
    results = linked.filter("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"), F.count("*").alias("n_results"))
    links = cut(calls.join(results, ["conv_id", "call_id"], "left"))

    # A call's place: no earlier than the results of the calls that it refers to.
    refs = cut(links.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(links.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]))
    turn = F.col("first.turn")
    open_ = cut(links.select("conv_id", "call_id", turn.alias("own"), F.coalesce("result_turn", turn).alias("ends")))
    waits = refs.groupBy("conv_id", "call_id").agg(F.count("*").alias("needs"))
    placed = cut(open_.join(waits, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("own").alias("order_turn"), F.greatest("own", "ends").alias("done"), F.lit(0).alias("level")))
    rest = cut(refs.join(placed, ["conv_id", "call_id"], "left_anti"))
    level = 0
    while not rest.isEmpty():  # what is left when a round places no call is on a cycle, or refers to one
        level += 1
        met = rest.join(placed.select("conv_id", F.col("call_id").alias("ref"), "done"), ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("have"), F.max("done").alias("after"))
        ready = met.join(waits.filter("needs > 0"), ["conv_id", "call_id"]).filter("have = needs").join(open_, ["conv_id", "call_id"])
        ready = ready.select("conv_id", "call_id", F.greatest("own", "after").alias("order_turn"), F.greatest("own", "after", "ends").alias("done"), F.lit(level).alias("level"))
        more = cut(ready)
        if more.isEmpty():
            break
        placed = cut(placed.union(more))
        rest = cut(rest.join(more.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    state = links.select("conv_id", "call_id", "first", "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results")).join(placed, ["conv_id", "call_id"], "left")

    first_here = F.col("first.row") == F.col("row")
    status = (
        F.when(F.col("kind") == "message", "message")
        .when((F.col("kind") == "result") & F.col("first").isNull(), "orphan_result")
        .when(F.col("kind") == "result", "result")
        .when(~first_here, "duplicate_call")
        .when(F.col("order_turn").isNull(), "cyclic_call")
        .when(F.col("n_results") == 0, "unanswered_call")
        .otherwise("call")
    )
    at = F.when(F.col("kind") == "result", F.greatest("turn", F.coalesce("order_turn", "turn"))).otherwise(F.coalesce("order_turn", "turn"))
    depth = F.coalesce("level", F.lit(0))
    order_level = F.when(F.col("kind") == "message", F.lit(0)).when(F.col("kind") == "result", 2 * depth + 1).otherwise(2 * depth)
    # Messages have no identifier; they don't take part in the join.
    columns = ["conv_id", "turn", "item", "role", "kind", "call_id", "valid", "json"]
    messages = items.filter("kind = 'message'").select(*columns, F.lit("message").alias("status"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"))
    tools = linked.join(state, ["conv_id", "call_id"], "left").select(*columns, status.alias("status"), at.alias("order_turn"), order_level.alias("order_level"))
    return messages.unionByName(tools)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "item", "role", "kind", "call_id", "valid", "status", "order_turn", "order_level", "json")


#: For tables whose turns hold no tool calls, as the test tables.
ORACLE_SQL = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS item, coalesce(role, 'user') AS role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
  CAST(NULL AS BOOLEAN) AS valid, 'message' AS status, turn AS order_turn, CAST(0 AS INTEGER) AS order_level,
  CAST(json_object('content', coalesce(text, ''), 'role', coalesce(role, 'user')) AS VARCHAR) AS json
FROM conversations
"""
