"""Language identification by Bayesian evidence fusion (operator 8).

The posterior of a document's language combines four kinds of evidence:

* the text: hashed byte-trigram likelihoods of every language that any row declares, counted over all
  rows and whole texts, tempered to ``EFFECTIVE`` trigrams;
* the declared language (markup attribute or column), whose reliability is counted over all rows;
* the address suffix (what follows the last dot of the host), counted over all rows;
* the host: its counts over all rows, smoothed towards its suffix, and that towards the whole corpus.

All counts are sums over every row, made in the tasks and added up.  A declaration is read as its primary
subtag: ``EN``, ``en `` and ``en-US`` are ``en``.  What has not two or three letters then, or stands in less than
``LEAST_SHARE`` of the rows that declare one (counted exactly), declares nothing; so there are at most
1 / LEAST_SHARE languages, with a table of 256 KB each.

Defined cases: a null or empty text has no text evidence and is rejected, as is a text without
letters; a null host, suffix or declaration is a value of its own; repeated rows count each time; of
languages that tie the first in alphabetical order is taken; an empty table gives no rows; other columns
pass through ``keep_known`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.bits import SHARE, merge_shares, share_rows
from corvid.llm.common import bound_batches, cut, lower_ascii, pieces, table, text_bytes
from corvid.llm.html_extraction import extract

BUCKETS = 1 << 15
#: What every trigram has been seen beforehand, for languages with few rows.
PRIOR = 0.05
EFFECTIVE = 60.0
#: Weights of the layers of the host prior, in documents.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
#: Documents whose best posterior is below this are rejected.
LEAST = 0.5
#: Declared languages in fewer of the declaring rows than this count as undeclared.
LEAST_SHARE = 1e-4
#: Lookup rows (about 100 bytes each) up to this many are sent to every executor.
BROADCAST_ROWS = 50_000


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = lower_ascii(data).astype(np.int32)
    return ((x[:-2] * 7919 + x[1:-1] * 104729 + x[2:] * 611953) & 0x7FFFFFFF) % BUCKETS


def fit(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(trigram | language) per language and hash bucket, from all rows of docs(d, t): declared language and text.

    A task keeps one table of counts, and sends it on in compressed blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts = {x: k for k, x in enumerate(langs)}, np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in pieces(batches, "t", 2 << 20):
            data, off = text_bytes(batch.column("t"))
            if len(data) < 3:
                continue
            key = _trigrams(data)
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))[: len(key)]
            inside = np.arange(len(key)) + 2 < off[1:][row]  # trigrams don't cross rows
            lang = np.array([place[x] for x in batch.column("d").to_pylist()], np.int64)
            np.add.at(counts, lang[row[inside]] * BUCKETS + key[inside], 1)
        yield pa.RecordBatch.from_arrays(list(share_rows(counts)), names=["block", "part"])

    counts = merge_shares(docs.select("d", "t").mapInArrow(run, SHARE), np.int64, lambda x: np.sum(x, axis=0))
    counts = (counts if len(counts) else np.zeros(len(langs) * BUCKETS)).reshape(len(langs), BUCKETS) + PRIOR
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_likelihoods(data: np.ndarray, off: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-likelihood per trigram and language (rows x languages), and whether the row has letters."""
    n = len(off) - 1
    out = np.zeros((n, len(tables)))
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) - 97 < 26) | (data >= 0xC3), out=letters[1:])
    count = np.maximum(np.diff(off) - 2, 0)
    if len(data) >= 3:
        key = _trigrams(data)
        first = np.minimum(off[:-1], len(key))
        last = np.minimum(off[:-1] + count, len(key))
        for k, t in enumerate(tables):
            run = np.zeros(len(key) + 1)
            np.cumsum(t[key], out=run[1:])
            out[:, k] = (run[last] - run[first]) / np.maximum(count, 1)
    return out, (letters[off[1:]] - letters[off[:-1]]) > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def primary_subtag(declared: Column) -> Column:
    """The language of a declaration in lower case; null where it has not the form of one."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


class LanguageFusion:
    """Fit once on a table, then score or filter it.  Columns: text, and optionally declared and host columns."""

    def __init__(self, docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source") -> None:
        bound_batches(docs.sparkSession)
        self.text, self.declared, self.host = text, declared, host
        self.langs = self._languages(docs) if declared else []
        rows = self._inner(docs, [])
        self.tables = fit(rows.filter("_declared <> '' AND length(_text) > 2").select(F.col("_declared").alias("d"), F.col("_text").alias("t")), self.langs) if self.langs else np.zeros((0, BUCKETS), np.float32)
        self.evidence = self._evidence(rows) if self.langs else None

    def _column(self, name: str | None) -> Column:
        return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")

    def _languages(self, docs: DataFrame) -> list[str]:
        per = docs.filter(F.length(self._column(self.text)) > 2).select(primary_subtag(self._column(self.declared)).alias("d")).filter("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("n"))
        total = per.agg(F.sum("n").alias("total"))
        return [r["d"] for r in per.crossJoin(F.broadcast(total)).filter(F.col("n") >= LEAST_SHARE * F.col("total")).orderBy("d").collect()]  # one row of totals; at most 1 / LEAST_SHARE languages

    def _inner(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The columns asked for as one struct ``row``, so that no name of theirs meets one of ours, and the text and the keys of its evidence."""
        declared, host = primary_subtag(self._column(self.declared)), F.coalesce(self._column(self.host), F.lit(""))
        row = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []
        known = F.when(declared.isin(self.langs), declared).otherwise("") if self.langs else F.lit("")
        return df.select(*row, self._column(self.text).alias("_text"), known.alias("_declared"), host.alias("_host"), F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise(F.lit("")).alias("_suffix"))

    def _text_scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` without the text, with _ll (log-likelihoods, tempered) and _letters."""
        tables, k = self.tables, len(self.langs)
        columns = [c for c in rows.columns if c != "_text"]
        schema = rows.select(columns).schema.add("_ll", T.ArrayType(T.DoubleType())).add("_letters", T.BooleanType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "_text", 2 << 20):
                data, off = text_bytes(batch.column(batch.schema.get_field_index("_text")))
                ll, letters = text_likelihoods(data, off, tables)
                ll = ll * np.minimum(np.maximum(np.diff(off) - 2, 0), EFFECTIVE)[:, None]
                arr = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(ll) + 1, k), pa.int32()), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), arr, pa.array(letters)], names=[*columns, "_ll", "_letters"])

        return rows.mapInArrow(run, schema)

    def _evidence(self, rows: DataFrame) -> DataFrame:
        """(_declared, _host, _suffix) -> _extra: log prior and log-likelihood of the declaration per language."""
        k = len(self.langs)
        keys = ["_declared", "_host", "_suffix"]
        scored = self._text_scores(rows).filter("_letters")
        top = F.array_max("_ll")
        soft = F.transform("_ll", lambda x: F.exp(x - top))
        total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
        sums = [F.sum(F.element_at(soft, i + 1) / total).alias(f"n{i}") for i in range(k)]
        base = cut(scored.groupBy(*keys).agg(*sums))
        ns = [f"n{i}" for i in range(k)]

        def counts(by: str, tag: str) -> DataFrame:
            return base.groupBy(by).agg(F.array(*[F.sum(n) for n in ns]).alias(tag))

        whole = base.agg(F.array(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in ns]).alias("_all"))
        plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        combos = base.select(*keys).crossJoin(F.broadcast(whole))  # one row
        for by, tag in (("_host", "_ch"), ("_suffix", "_cs"), ("_declared", "_cd")):
            combos = combos.join(counts(by, tag), by)
        p0 = F.transform("_all", lambda x: (x + 1.0) / (plus("_all") + float(k)))
        ps = F.zip_with("_cs", p0, lambda c, p: (c + SUFFIX_WEIGHT * p) / (plus("_cs") + SUFFIX_WEIGHT))
        ph = F.zip_with("_ch", ps, lambda c, p: (c + HOST_WEIGHT * p) / (plus("_ch") + HOST_WEIGHT))
        # P(declared | language), smoothed by one count over as many values as languages.
        pd_ = F.zip_with("_cd", "_all", lambda c, a: (c + 1.0) / (a + float(k)))
        combos = combos.withColumn("_ph", ph).withColumn("_pd", pd_)
        none = F.transform("_ph", lambda p: F.log(p))
        both = F.zip_with("_ph", "_pd", lambda p, q: F.log(p) + F.log(q))
        return cut(combos.select(*keys, F.when(F.col("_declared") == "", none).otherwise(both).alias("_extra")))

    def _scored(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The columns as ``row``, with language, posterior, text_language, kept."""
        rows = self._inner(df, columns)
        if self.evidence is None:
            null = F.lit(None)
            return rows.select("row", null.cast("string").alias("language"), null.cast("double").alias("posterior"), null.cast("string").alias("text_language"), F.lit(False).alias("kept"))
        evidence = self.evidence
        if evidence.count() <= BROADCAST_ROWS:
            evidence = F.broadcast(evidence)
        flat = F.array(*[F.lit(-float(np.log(len(self.langs))))] * len(self.langs))
        langs = F.array(*[F.lit(x) for x in self.langs])
        best = lambda a: F.element_at(langs, F.array_position(a, F.array_max(a)).cast("int"))
        post = F.zip_with("_ll", F.coalesce("_extra", flat), lambda a, b: a + b)
        joined = self._text_scores(rows).join(evidence, ["_declared", "_host", "_suffix"], "left").withColumn("_post", post)
        total = F.aggregate(F.transform("_post", lambda x: F.exp(x - F.array_max("_post"))), F.lit(0.0), lambda a, x: a + x)
        kept: Column = F.col("_letters") & (F.lit(1.0) / total >= LEAST)
        return joined.select("row", best(F.col("_post")).alias("language"), (F.lit(1.0) / total).alias("posterior"), F.when(F.col("_letters"), best(F.col("_ll"))).alias("text_language"), kept.alias("kept"))

    def score(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of ``df`` with language, posterior, text_language, kept."""
        return self._scored(df, columns).select("row.*", "language", "posterior", "text_language", "kept")

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` that are not rejected, as they are."""
        return self._scored(df, df.columns).filter("kept").select("row.*")


def keep_known(docs: DataFrame, declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return LanguageFusion(docs, "text", declared, host).keep(docs)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return LanguageFusion(docs).score(docs, ["doc_id", "lang"])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, lang, host of pages(page_id, url, html): the main text, the language that the markup declares, and the address's host."""
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1))
    texts = extract(pages).select("page_id", F.col("url").alias("_url"), "text")
    marks = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("_url"), F.nullif(declared, F.lit("")).alias("lang"), host.alias("host")).distinct()
    return texts.join(marks, (texts["page_id"].eqNullSafe(marks["page_id"])) & (texts["_url"].eqNullSafe(marks["_url"])), "left").select(texts["page_id"], "text", "lang", "host")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' languages from text, markup, address suffix and host."""
    rows = cut(page_texts(table(spark, sf_dir, "pages")))
    return LanguageFusion(rows, "text", "lang", "host").score(rows, ["page_id", "lang", "host"])
