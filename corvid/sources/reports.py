
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalars import lookup

_NONE = "array<variant>"


def _steps(path: str) -> Column:
    """The parts of a path as structs of key and place: ``a.b[2].c``."""
    out = []
    for part in (p for p in re.split(r"\.(?![^\[]*\])", path) if p):
        m = re.fullmatch(r"([^\[]*)\[(\d+)\]", part)
        out.append(F.struct(F.lit(m[1] if m else part).alias("key"), F.lit(int(m[2]) if m else -1).alias("at")))
    return F.array(*out)


def _present(value: Column) -> Column:
    """Null for a null of the document, too."""
    return F.when(~F.is_variant_null(value), value)


def _field(at: Column, key: Column) -> Column:
    return _present(F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), key))


def _item(at: Column, place: Column) -> Column:
    return _present(F.get(F.try_variant_get(at, "$", _NONE), place))


def selected(document: Column, selector: str) -> Column:
    """[S18] The rows that a selector names: ``$``, ``$.a.b``, ``$.a[0].b``, with ``[*]`` at the end for the items of a list only.

    A key on a list is looked up in each of its objects, and lists found so become one.  A list gives its items, any other value itself, and what is missing nothing.
    """
    path = selector[2:] if selector.startswith("$.") else selector.removeprefix("$")
    only_lists = path.endswith("[*]")
    path = path.removesuffix("[*]")

    def step(at: Column, part: Column) -> Column:
        items = F.try_variant_get(at, "$", _NONE)
        each = F.filter(F.transform(items, lambda x: _field(x, part["key"])), lambda v: v.isNotNull())
        spread = F.to_variant_object(F.flatten(F.transform(each, lambda v: F.coalesce(F.try_variant_get(v, "$", _NONE), F.array(v)))))
        inner = F.when(part["key"] == "", at).otherwise(_field(at, part["key"]))
        return F.when(part["at"] >= 0, _item(inner, part["at"])).when(items.isNotNull(), spread).otherwise(_field(at, part["key"]))

    end = F.aggregate(_steps(path), document, step) if path else document
    alone = F.array().cast(_NONE) if only_lists else F.array(end)
    return F.when(end.isNull(), F.array().cast(_NONE)).otherwise(F.coalesce(F.try_variant_get(end, "$", _NONE), alone))


def dug(row: Column, path: str) -> Column:
    """The value under a path of a row; numbers are places of lists.  Null where there is none."""
    step = lambda at, part: F.when(part["at"] >= 0, _item(F.when(part["key"] == "", at).otherwise(_field(at, part["key"])), part["at"])).otherwise(F.coalesce(_field(at, part["key"]), F.when(part["key"].rlike("^[0-9]{1,9}$"), _item(at, part["key"].try_cast("int")))))
    return F.aggregate(_steps(path), row, step) if path else F.lit(None).cast("variant")


def tool_rows(outputs: DataFrame, selector: str = "$", lines: bool = False) -> DataFrame:
    """[S18] The rows (all columns of outputs but ``text``, and ``place``, ``row``) of tool outputs in ``text``.

    ``lines``: a JSON document a line, lines that are none are left out.  Else one document, after any banner
    before its first bracket; a list of result objects gives the rows of each where the selector finds none in the whole.
    """
    keys = [F.col(f"`{c}`") for c in outputs.columns if c != "text"]
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    if lines:
        each = outputs.select(*keys, F.posexplode(F.split(text, "\n")).alias("place", "line"))
        return each.select(*keys, "place", F.try_parse_json(F.trim("line")).alias("row")).filter("row IS NOT NULL")
    start = F.regexp_instr(text, F.lit(r"[\[{]"))
    document = F.coalesce(F.try_parse_json(F.when(text != "", text)), F.when(start > 0, F.try_parse_json(F.substring(text, start, F.length(text)))))
    docs = outputs.select(*keys, document.alias("document"))
    rows = selected(F.col("document"), selector)
    if selector.startswith("$."):
        inner = F.flatten(F.transform(F.try_variant_get("document", "$", _NONE), lambda x: selected(x, selector)))
        rows = F.when(F.size(rows) > 0, rows).otherwise(F.coalesce(inner, F.array().cast(_NONE)))
    return docs.select(*keys, F.posexplode(rows).alias("place", "row"))


def tool_findings(rows: DataFrame, fields: dict[str, list[str]], severities: dict[str, str] | None = None, default: str = "medium") -> DataFrame:
    """[S18] ``rows`` with the fields as texts, each from the first of its paths that is there; a severity is looked up in any case, else ``default``."""
    out = rows
    for name, paths in fields.items():
        text = F.coalesce(*[F.try_variant_get(dug(F.col("row"), p), "$", "string") for p in paths])
        out = out.withColumn(name, F.coalesce(lookup(F.lower(text), {k.lower(): v for k, v in (severities or {}).items()}), F.lit(default)) if name == "severity" else text)
    return out.drop("row")
