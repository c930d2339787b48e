
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.graphs import cut

CACHE = "probe string, key string, result string, turn long, part int, seq long"
MOST_KEYS = 50_000


class Step(NamedTuple):
    """One batch through the cache: answers (probe, key, result, hit), divergences (probe, key, cached, fresh), the cache after it, and counts."""

    answers: DataFrame
    divergences: DataFrame
    cache: DataFrame
    counts: dict[str, int]


def cache_step(cache: DataFrame, work: DataFrame, turn: int, fresh: Callable[[DataFrame], DataFrame], most: int = MOST_KEYS, share: float = 0.0) -> Step:
    """[I8, Z4] What work(probe, key, seq, ...) asks, from the cache or made anew by ``fresh``: rows of work -> (probe, key, result).

    A share of the hits, one at least, is made anew too; hashes of probe, key and turn choose them, so a
    batch that runs again chooses the same.  Where such a result differs it is reported, and replaces the
    cached one.  Hits count as used in the order of ``seq``, what was made anew after them.  Above
    ``most`` keys the oldest of each probe go, one probe after the other in the order of their names,
    until enough have gone.  Only the rows to go are ordered: as many as the batch has added.
    """
    asked = cut(work.groupBy("probe", "key").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*[c for c in work.columns if c not in ("probe", "key")]), "seq").alias("r")))
    known = cache.select("probe", "key", "result")
    hits = cut(asked.join(known, ["probe", "key"]))
    n_hits, n_asked = hits.count(), asked.count()
    picked = min(n_hits, max(1, round(n_hits * share))) if share > 0 and n_hits else 0
    sample = cut(hits.orderBy(F.xxhash64("probe", "key", F.lit(turn)), "probe", "key").limit(picked).select("probe", "key", F.col("result").alias("cached")))
    again = asked.join(hits.select("probe", "key"), ["probe", "key"], "left_anti").unionByName(asked.join(sample.select("probe", "key"), ["probe", "key"], "left_semi"))
    rows = again.select("probe", "key", *[F.col(f"r.`{c}`").alias(c) for c in work.columns if c not in ("probe", "key")])
    made = cut(again.select("probe", "key", "seq").join(fresh(rows).select("probe", "key", "result"), ["probe", "key"], "left").withColumn("result", F.coalesce("result", F.lit("[]"))))
    kept = hits.join(sample.select("probe", "key"), ["probe", "key"], "left_anti")
    answers = kept.select("probe", "key", "result", F.lit(True).alias("hit")).unionByName(made.select("probe", "key", "result", F.lit(False).alias("hit")))
    divergences = cut(sample.join(made.select("probe", "key", F.col("result").alias("fresh")), ["probe", "key"]).filter("cached <> fresh"))
    untouched = cache.join(asked.select("probe", "key"), ["probe", "key"], "left_anti")
    new = lambda df, part: df.select("probe", "key", "result", F.lit(turn).cast("long").alias("turn"), F.lit(part).alias("part"), "seq")
    after = cut(untouched.select("probe", "key", "result", "turn", "part", "seq").unionByName(new(kept, 0)).unionByName(new(made, 1)))
    sizes = {r["probe"]: r["n"] for r in after.groupBy("probe").agg(F.count("*").alias("n")).collect()}  # a row for each probe
    gone = evicted(sizes, most)
    for probe, n in gone.items():
        if n:
            oldest = after.filter(F.col("probe") == probe).orderBy("turn", "part", "seq", "key").limit(n).select("probe", "key")
            after = cut(after.join(oldest, ["probe", "key"], "left_anti"))
    return Step(answers, divergences, after, {"hits": n_hits, "misses": n_asked - n_hits, "verified": picked, "divergent": divergences.count(), "evicted": sum(gone.values())})


def evicted(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each probe go: one of each in turn, by name, until ``most`` are left."""
    over, out = sum(sizes.values()) - most, dict.fromkeys(sorted(sizes), 0)
    while over > 0:
        live = [p for p in out if sizes[p] > out[p]]
        whole = min(over // len(live), min(sizes[p] - out[p] for p in live))
        for p in live:
            out[p] += whole
        over -= whole * len(live)
        if not whole:  # less than one of each is left to go
            for p in live[:over]:
                out[p] += 1
            over = 0
    return out


def cached_stream(work: DataFrame, home: str, fresh: Callable[[DataFrame], DataFrame], most: int = MOST_KEYS, share: float = 0.0):
    """[Z4] A writer of the stream ``work``: answers, divergences and the cache of each micro-batch as Parquet under ``home``.

    ``answers/batch=n`` and ``cache/batch=n`` are written whole, so that a micro-batch that runs again
    gives the same; the cache before the last one is deleted.  Start it with a checkpointLocation.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = read_cache(spark, home, n - 1)
        step = cache_step(before, batch, n, fresh, most, share)
        step.answers.write.mode("overwrite").parquet(f"{home}/answers/batch={n}")
        step.divergences.write.mode("overwrite").parquet(f"{home}/divergences/batch={n}")
        step.cache.write.mode("overwrite").parquet(f"{home}/cache/batch={n}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/cache/batch={n - 2}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return work.writeStream.foreachBatch(run)


def read_cache(spark: SparkSession, home: str, batch: int) -> DataFrame:
    """The cache after a micro-batch; empty before the first."""
    if batch < 0:
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(f"{home}/cache/batch={batch}")
