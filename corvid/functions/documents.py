
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_path(document: Column, dotted: str, exact: bool = False) -> Column:
    """The value under a dotted path: keys as written, else in any case (the last such key); numbers are places of a list.  Null where there is none."""

    def step(at: Column, part: Column) -> Column:
        fields, items = F.try_variant_get(at, "$", "map<string,variant>"), F.try_variant_get(at, "$", "array<variant>")
        alike = F.try_element_at(F.filter(F.map_keys(fields), lambda k: F.lower(k) == F.lower(part)), F.lit(-1))
        found = F.try_element_at(fields, part) if exact else F.when(F.map_contains_key(fields, part), F.try_element_at(fields, part)).otherwise(F.try_element_at(fields, alike))
        return F.when(fields.isNotNull(), found).when(items.isNotNull() & part.rlike("^[0-9]{1,9}$"), F.get(items, part.try_cast("int")))

    return F.aggregate(F.array(*[F.lit(x) for x in dotted.split(".")]), document, step)


def items_of(value: Column) -> Column:
    """The items of a list; anything else as a list of itself; null for nothing and for a null."""
    return F.when(value.isNotNull() & ~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def is_truthy(value: Column) -> Column:
    """Whether a value says yes: texts by their word, numbers other than 0, lists and objects with anything in them."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    fields, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    said = F.when(kind == "STRING", F.lower(F.trim(text)).isin("true", "yes", "1", "enabled", "on")).when(kind == "BOOLEAN", text == "true")
    return F.coalesce(said.when(fields.isNotNull(), F.size(fields) > 0).when(items.isNotNull(), F.size(items) > 0).otherwise(text.try_cast("double") != 0), F.lit(False))


def text_of(value: Column) -> Column:
    """A scalar as rule files write it: ``True`` and ``False`` for booleans, ``None`` for a null or nothing."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(value.isNull() | F.is_variant_null(value), "None").when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(text, F.to_json(value)))


def string_values(column: str) -> Column:
    """All texts of a document that are values, not keys."""
    tokens = F.regexp_extract_all(F.to_json(F.col(column)), F.lit(r'"(?:[^"\\]|\\.)*+":?'), 0)
    values = F.filter(tokens, lambda t: ~F.endswith(t, F.lit('":')))
    return F.transform(values, lambda t: F.substring(t, F.lit(2), F.length(t) - 2))


def document_text(column: str) -> Column:
    """A document as one lower-case text, with a blank after each colon and comma between its values."""
    tokens = F.regexp_extract_all(F.to_json(F.col(column)), F.lit(r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^"{}\[\],:]+'), 0)
    return F.lower(F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), ""))
