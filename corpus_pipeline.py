"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes every stage's rows as Parquet in the shared checkpoint folder and reads
them again for the next one.

Defined cases: a null or empty text has no language and goes at the first stage, as does one without
letters; rows with a null id or a null source take part like any other; of rows with one id and equal
texts one stays, of rows with one id and different texts each is judged by itself; texts of any length
are read whole; ties between copies go to the least id; an empty table gives no rows; further columns
stay until the last stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.best_fit_packing import pack_documents
from corvid.llm.common import ensure_checkpoint_dir, table
from corvid.llm.decontamination import drop_leaking
from corvid.llm.jaccard_join import one_of_each
from corvid.llm.language_id import keep_known
from corvid.llm.pii import mask_pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language stay."""
    return keep_known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked; every document stays."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces, packed into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can't express the language model, the tagger and the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``.  A stage's Parquet is deleted once the next one is written; the last one's stays."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{home}/{name}"
    return docs
