"""Aliases, renumbering and the cache on small rows."""

from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import registry as rg
from corvid.streaming import cache as ca


def test_aliases_are_followed_to_their_ends(spark):
    chain = [(f"A{k:03}", f"A{k + 1:03}") for k in range(100)]
    rows = [*chain, ("B1", "B2"), ("B2", "B1"), ("C", "B1"), ("D", "D"), ("E", "X"), ("E", "W"), ("Z", "A050")]
    got = {r["old"]: r["new"] for r in rg.follow_aliases(spark.createDataFrame(rows, "old string, new string")).collect()}
    assert got == {f"A{k:03}": "A100" for k in range(100)} | {"B1": "B2", "B2": "B1", "C": "B1", "E": "W", "Z": "A100"}
    assert rg.follow_aliases(spark.createDataFrame([], "old string, new string")).count() == 0


def test_ids_change_places_at_once(spark):
    texts = spark.createDataFrame([(1, "R-1 and R-2, not R-10 or XR-1; R-1."), (2, "none"), (3, None), (4, "é R-3\nR-3-a")], "k int, text string")
    mapping = spark.createDataFrame([("R-1", "R-2"), ("R-2", "R-1"), ("R-3", "Q$1")], "old string, new string")
    got = {r["k"]: (r["text"], r["changes"]) for r in rg.replace_ids(texts, "k", mapping).collect()}
    assert got == {1: ("R-2 and R-1, not R-10 or XR-1; R-2.", 3), 2: ("none", 0), 3: (None, 0), 4: ("é Q$1\nR-3-a", 1)}


def test_renumbering(spark):
    requirements = spark.createDataFrame([("REQ-001", "a"), ("REQ-1234", "b"), ("OTHER-001", "c")], "id string, title string")
    aliases = spark.createDataFrame([("OLD-1", "REQ-001"), ("REQ-001", "REQ-009")], "old string, new string")
    rows, new = rg.renumber(requirements, aliases, "REQ", "ARB")
    assert {r["id"] for r in rows.collect()} == {"ARB-001", "REQ-1234", "OTHER-001"}
    assert {tuple(r) for r in new.collect()} == {("REQ-001", "ARB-001"), ("OLD-1", "ARB-001")}
    texts = spark.createDataFrame([("REQ-001, REQ-0012 and XREQ-002 REQ-003-x",), (None,)], "text string")
    assert sorted((str(r["text"]), r["changes"]) for r in rg.renumber_texts(texts, "REQ", "ARB").collect()) == [("ARB-001, REQ-0012 and XREQ-002 ARB-003-x", 2), ("None", 0)]
    with pytest.raises(ValueError, match="prefix"):
        rg.renumber(requirements, aliases, "REQ", "arb")


def test_eviction_takes_one_of_each_probe_in_turn():
    def brute(sizes, most):
        left = dict(sorted(sizes.items()))
        while sum(left.values()) > most:
            for p in left:
                if left[p] and sum(left.values()) > most:
                    left[p] -= 1
        return {p: sizes[p] - n for p, n in left.items()}

    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = {f"p{k}": int(n) for k, n in enumerate(rng.integers(0, 30, int(rng.integers(1, 6))))}
        most = int(rng.integers(0, 90))
        assert ca.evicted(sizes, most) == brute(sizes, most)


def answer(rows):
    """A result that depends on the key alone, except for the probe that forgets a part of it."""
    return rows.select("probe", "key", F.when(F.col("probe") == "bad", F.concat("key", F.lit(":"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("r:"), "key")).alias("result"))


def test_stream_of_the_cache_is_an_ordered_table(spark, tmp_path):
    rng = np.random.default_rng(7)
    schema, most = "probe string, key string, seq long", 12
    batches = [[("bad" if rng.random() < 0.3 else f"p{rng.integers(2)}", f"k{rng.integers(12)}", 1000 * b + i) for i in range(15)] for b in range(4)]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    home = str(tmp_path / "home")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = ca.cached_stream(stream, home, answer, most, 1.0).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(300)
    # Every hit is verified: what was cached under another sequence diverges.
    entries, diverged, got = OrderedDict(), [], []
    for rows in batches:
        asked = {}
        for probe, key, seq in rows:
            asked.setdefault((probe, key), seq)
        order = sorted(asked.items(), key=lambda x: x[1])
        hits = [x for x, _ in order if x in entries]
        made = {x: f"{x[1]}:{seq}" if x[0] == "bad" else f"r:{x[1]}" for x, seq in order}
        diverged += [(*x, entries[x], made[x]) for x in hits if entries[x] != made[x]]
        got += [(*x, made[x]) for x in made]
        for x, _ in order:
            entries.pop(x, None)
            entries[x] = made[x]
        for probe, n in ca.evicted({p: sum(k[0] == p for k in entries) for p in {k[0] for k in entries}}, most).items():
            for x in [k for k in entries if k[0] == probe][:n]:
                del entries[x]
    assert sorted((r["probe"], r["key"], r["result"]) for r in spark.read.parquet(f"{home}/answers").collect()) == sorted(got)
    assert sorted((r["probe"], r["key"], r["cached"], r["fresh"]) for r in spark.read.parquet(f"{home}/divergences").collect()) == sorted(diverged) and diverged
    assert {(r["probe"], r["key"]): r["result"] for r in ca.read_cache(spark, home, 3).collect()} == dict(entries)


def test_part_of_the_hits_is_verified(spark):
    cache = spark.createDataFrame([("p", f"k{k}", "r:k0" if k == 0 else f"r:k{k}", 0, 1, k) for k in range(20)], ca.CACHE)
    work = spark.createDataFrame([("p", f"k{k}", k) for k in range(15, 25)], "probe string, key string, seq long")
    step = ca.cache_step(cache, work, 1, answer, 22, 0.4)
    assert step.counts == {"hits": 5, "misses": 5, "verified": 2, "divergent": 0, "evicted": 3}
    assert {r["key"] for r in step.cache.collect()} == {f"k{k}" for k in range(3, 25)}
    assert {r["key"]: r["result"] for r in step.answers.collect()} == {f"k{k}": f"r:k{k}" for k in range(15, 25)} and step.answers.filter("hit").count() == 3


def test_blame_and_added_headings(spark):
    from corvid.sources import records as rc

    a, b = "a" * 40, "b" * 40
    text = f"{a} 3 1 2\nauthor x\nsummary {b} 9 9\n\tcode {b} 1 7\n{a} 4 2\n\tmore\n{'0' * 40} 1 3 1\n\tnew\n{b} 1 4\r\n{b} 8 5 1\n"
    got = rc.git_blame(spark.createDataFrame([("f.py", text), ("e.py", None)], "path string, text string")).collect()
    assert {tuple(r) for r in got} == {("f.py", 1, a), ("f.py", 2, a), ("f.py", 4, b), ("f.py", 5, b)}
    diff = "--- a/CHANGELOG.md\n+++ b/CHANGELOG.md\n@@ -1 +1,3 @@\n # Log\n+## 2024-01-02 New ##\n+text\n-## Gone\n+### Part\n+##no\n"
    rows = rc.added_headings(spark.createDataFrame([("h", diff)], "hash string, text string")).orderBy("n").collect()
    assert [(r["hash"], r["heading"]) for r in rows] == [("h", "2024-01-02 New"), ("h", "Part")]


def test_partial_scans_read_what_changed_and_its_context(spark):
    from corvid.operators import changes as ch

    rows = [("r", "src/a.py", "source", False, 10), ("r", "b.py", "source", False, 20), ("q", "src/a.py", "source", False, 5), ("r", "x/Dockerfile.dev", "config", False, 1), ("r", "go.mod", "config", True, 1), ("r", "m.TF", "iac", False, 2), ("r", ".ci.yml", "ci", False, 3)]
    files = spark.createDataFrame(rows, "repo_id string, path string, role string, binary boolean, lines int")
    lists = [spark.createDataFrame([(r, t)], "repo_id string, text string") for r, t in (("r", "src/a.py\n\ngone.py\r\n"), ("r", " src/a.py "), ("q", None))]
    out = ch.narrowed(files, ch.changed_paths(lists))
    assert {(r["repo_id"], r["path"]) for r in out.filter("read").collect()} == {("r", "src/a.py"), ("r", "x/Dockerfile.dev"), ("r", "m.TF"), ("r", ".ci.yml")}
    assert out.filter("changed").count() == 1
    stats = ch.scan_statistics(out).first()
    assert (stats["files"], stats["files_read"], stats["changed"], stats["context"], stats["lines_read"]) == (7, 4, 1, 3, 16)
