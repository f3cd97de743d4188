"""The catalog's queries against SQL on the driver's tables, and odd rows by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions import text
from reelspark.operators import library, matching, metadata, snapshot, subtitles
from reelspark.plans import queries
from reelspark.streaming import changes
from tests.compare import differences

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == []


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    for gone in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("reelspark.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, gone)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_scalars(spark):
    names = ["The Café & the Bar!", "L'été", "An", "", None, "the the"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_title(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == ["cafe and the bar", "l ete", "an", "", None, "the"]
    pairs = [("a b", "a b", 1.0), ("", "", 0.0), ("alpha beta", "gamma alpha", 0.5), ("colour", "color", 5 / 6), ("abc", "xyz", 0.0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == pytest.approx([p[2] for p in pairs])
    got = spark.range(1).select(text.runtime_agreement(F.lit(100), F.lit(101)).alias("a"), text.runtime_agreement(F.lit(0), F.lit(5)).alias("b"), text.human_size(F.lit(1536)).alias("c"), text.human_size(F.lit(5)).alias("d")).first()
    assert tuple(got) == (1.0, 0.0, "1.5 KiB", "5 B")


def test_moves_are_claimed_once(spark):
    columns = "path string, size long, sketch string"
    index = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "y"), ("same", 3, "z")], columns)
    observed = spark.createDataFrame([("n1", 1, "x"), ("n2", 1, "x"), ("same", 4, "z")], columns)
    got = {(r["path"], r["verdict"], r["from_path"]) for r in snapshot.reconcile(index, observed).collect()}
    assert got == {("n1", "moved", "b"), ("n2", "new", None), ("same", "modified", None), ("a", "tombstoned", None), ("c", "tombstoned", None)}
    empty = index.filter("false")
    assert {r["verdict"] for r in snapshot.reconcile(empty, observed).collect()} == {"new"}


@pytest.mark.parametrize("seed", range(4))
def test_budget_and_cache_like_a_loop(spark, seed):
    r = random.Random(seed)
    rows = sorted((r.randint(0, 2), f"p{r.randint(0, 99999):05d}", r.choice([0, 5, 30, 80])) for _ in range(40))
    files, budget = spark.createDataFrame(rows, "tier int, path string, size long"), r.choice([0, 60, 400, 10**6])
    want, total = [], 0
    for k, (_, path, size) in enumerate(rows):
        if k and total + size > budget:
            break
        total += size
        want.append(path)
    assert sorted(x["path"] for x in snapshot.verify_within(files, budget).collect()) == sorted(want)
    cache = [(k, r.randint(0, 40), r.randint(1, 50), r.randint(0, 3) == 0) for k in range(60)]
    entries = spark.createDataFrame([(k, d, s, int(b)) for k, d, s, b in cache], "id long, d int, size long, readers int").withColumn("used", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    gone = {k for k, d, _, b in cache if not b and 45 - d > 20}
    left = sum(s for k, _, s, _ in cache if k not in gone)
    for k, _, s, b in sorted(cache, key=lambda x: (x[1], x[0])):
        if k not in gone and not b and left > 500:
            gone.add(k)
            left -= s
    now = F.date_add(F.lit("2020-01-01").cast("date"), F.lit(45))
    assert {x["id"] for x in snapshot.evict(entries, now, 20, 500).collect()} == gone


def test_rate_limit_like_a_loop(spark):
    r = random.Random(2)
    rows = sorted((k, r.randint(0, 3000), i) for i, k in enumerate(r.choice([1, 1, 1, 2, 3]) for _ in range(300)))
    log, want = {}, set()
    for k, at, i in rows:
        log[k] = [t for t in log.get(k, []) if at - t < 500]
        if len(log[k]) < 3:
            log[k].append(at)
            want.add(i)
    got = changes.admitted(spark.createDataFrame(rows, "key long, at_ms long, id long"), 3, 500).filter("admitted").collect()
    assert {x["id"] for x in got} == want


def test_bursts_of_a_stream_and_a_table_agree(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{s:06.3f}") for k, s in [(1, 0.0), (1, 1.0), (1, 2.4), (1, 5.0), (2, 1.0), (2, 2.5)]] + [(9, "2024-01-01 02:00:00")]
    table = spark.createDataFrame(rows, "key long, at string").withColumn("at", F.to_timestamp("at"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    run = changes.debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    run.awaitTermination(120)
    got = {(r["key"], r["n"]) for r in spark.table("bursts").collect()}
    want = {(r["key"], r["n"]) for r in changes.debounce(table).collect()}
    assert want == {(1, 3), (1, 1), (2, 2), (9, 1)} and got == want - {(9, 1)}  # the last burst is still open


def test_fields_and_artwork(spark):
    fragments = spark.createDataFrame([(1, "p", "t", " "), (1, "q", "t", "z"), (1, "r", "t", "b"), (1, "r", "t", "a"), (2, "p", "t", None)], "item long, provider string, field string, value string")
    ranking = spark.createDataFrame([("p", 0), ("r", 1)], "provider string, pos int")
    assert [tuple(r) for r in metadata.merge_fields(fragments, ranking).collect()] == [(1, "t", "a", "r", 2)]
    pictures = spark.createDataFrame([(1, "poster", 0, None, 0, 10, "u"), (1, "poster", 0, 9.0, 40, 10, "v"), (1, "poster", 1, 9.9, 999, 99, "w")], "item long, kind string, provider_rank int, rating double, votes long, width int, url string")
    assert [r["url"] for r in metadata.best_artwork(pictures).collect()] == ["v"]


def test_cues_and_matches(spark):
    cues = spark.createDataFrame([(1, 0, 0, 1000, "x" * 40), (1, 1, 900, 2000, "y"), (1, 2, 500, 600, "z"), (1, 3, 650, 650, "")], "track long, at long, start_ms long, end_ms long, text string")
    assert [tuple(r) for r in subtitles.cue_checks(cues).orderBy("cue").collect()] == [(1, 1, "overlap"), (1, 2, "out_of_order"), (1, 3, "gap")]
    names = spark.createDataFrame([(1, "blue moon", 100, "b"), (2, "blue moon", 101, "b"), (3, "other thing", 900, "b"), (4, "blue moon", 100, "c")], "id long, title string, runtime long, block string")
    got = {r["query"]: (r["candidate"], r["verdict"]) for r in matching.best_candidates(names, names, ["block"]).collect()}
    assert got == {1: (2, "matched"), 2: (1, "matched")}
    files = spark.createDataFrame([("b/x", 1), ("a/y", 1), ("a/x", 2)], "path string, size long")
    assert [r["path"] for r in library.name_order(files).orderBy("position").collect()] == ["a/x", "a/y", "b/x"]
