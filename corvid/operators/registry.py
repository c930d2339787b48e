
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.graphs import cut


def follow_aliases(aliases: DataFrame) -> DataFrame:
    """[I12] (old, new): every old id of aliases(old, new) with the id at the end of its chain.

    Every id points on to where its target points, so the distance doubles in each round and a chain of n
    takes log2 n of them.  Of several targets the least counts.  Ids on or before a circle have no end; they keep
    the target that is written.
    """
    first = cut(aliases.filter("old <> new").groupBy("old").agg(F.min("new").alias("new")))
    ends, rounds, most = first, 0, max(1, first.count()).bit_length() + 1
    while rounds < most:
        rounds += 1
        ahead = ends.select(F.col("old").alias("new"), F.col("new").alias("further"))
        ends = cut(ends.join(ahead, "new", "left").select("old", F.coalesce("further", "new").alias("new")))
        if ends.join(first.select(F.col("old").alias("new")), "new", "left_semi").isEmpty():
            return ends
    # What still points at an id that has a target is caught in a circle.
    lost = ends.join(first.select(F.col("old").alias("new")), "new", "left_semi").select("old")
    return ends.join(lost, "old", "left_anti").unionByName(first.join(lost, "old", "left_semi"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+"), 0)


def replace_ids(texts: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """[I12] ``texts`` (key, text, ...) with ``text`` rewritten and ``changes``: each whole token that is an old id of mapping(old, new) becomes its new one.

    All are replaced at once, so ids can change places.  A text's own ids meet the mapping by equality; the
    mapping is never sent whole.
    """
    used = texts.select(key, F.explode(F.array_distinct(_tokens(F.coalesce("text", F.lit(""))))).alias("old")).filter(F.col("old").rlike("^[A-Za-z0-9_-]+$"))
    found = used.join(mapping.select("old", "new").dropDuplicates(["old"]), "old").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))
    rows = texts.join(found, key, "left")
    tokens = _tokens(F.col("text"))
    hits = F.size(F.filter(tokens, lambda t: F.map_contains_key(F.col("_map"), t)))
    new = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.col("_map"), t), t)), "")
    return rows.withColumns({"changes": F.when(F.col("_map").isNull(), 0).otherwise(hits), "text": F.when(F.col("_map").isNull(), F.col("text")).otherwise(new)}).drop("_map")


def renumber(requirements: DataFrame, aliases: DataFrame, old_prefix: str, new_prefix: str) -> tuple[DataFrame, DataFrame]:
    """[I12] Requirements(id, ...) under a new prefix, and the aliases(old, new) that keep the old ids valid.

    Ids of the old prefix and three digits change; an alias there is keeps its oldest id and follows the rename.
    """
    if not new_prefix.isalpha() or not new_prefix.isascii() or new_prefix != new_prefix.upper():
        raise ValueError("a prefix is upper-case letters")
    to = lambda c: F.regexp_replace(c, rf"\b\Q{old_prefix}\E-(\d{{3}})\b", f"{new_prefix}-$1")
    fits = F.col("id").rlike(rf"^\Q{old_prefix}\E-\d{{3}}$")
    own = requirements.filter(fits).select(F.col("id").alias("old"), to(F.col("id")).alias("new"), F.lit(0).alias("rank")).distinct()
    kept = aliases.select("old", to(F.col("new")).alias("new"), F.lit(1).alias("rank"))
    return requirements.withColumn("id", to(F.col("id"))), own.unionByName(kept).groupBy("old").agg(F.min_by("new", F.struct("rank", "new")).alias("new"))


def renumber_texts(texts: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """[I12] ``texts`` with the ids of the old prefix and three digits rewritten in ``text``, and the number of ``changes``."""
    pattern = rf"\b\Q{old_prefix}\E-(\d{{3}})\b"
    return texts.withColumns({"changes": F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))), "text": F.regexp_replace("text", pattern, f"{new_prefix}-$1")})
