"""Recovery, acquisition, paired runs, stable ids and folder context by hand and like loops, and on odd rows."""

import random

from pyspark.sql import functions as F

from reelspark.operators import recovery
from reelspark.plans import playback


def climb(failures):
    rung, seen, n = 0, {0}, 0
    for f in failures:
        n += 1
        first = recovery.FIRST_RUNG[f]
        if first is None or rung == 10:
            return n, recovery.RUNGS[rung], "terminal" if first is None else "exhausted", f if first is None else None, rung > 2, bool(seen & {4, 5, 7, 9, 10})
        rung = max(first, rung + 1)
        seen.add(rung)
    return n, recovery.RUNGS[rung], "open", None, rung > 2, bool(seen & {4, 5, 7, 9, 10})


def test_recovery_like_a_loop(spark):
    r = random.Random(7)
    helped = [f for f, first in recovery.FIRST_RUNG.items() if first is not None]
    items = {k: [r.choice(helped if k % 3 else list(recovery.FIRST_RUNG)) for _ in range(r.randint(1, 14))] for k in range(60)}
    items[60], items[None] = ["no_streams_found"] * 400, ["decode_error"]
    rows = [(k, n // 2, n, f) for k, fs in items.items() for n, f in enumerate(fs)] + [(61, 1, 1, None), (61, 2, 2, "unheard of")]
    schema = "item long, at long, id long, failure string"
    got = {x[0]: tuple(x)[1:] for x in recovery.recovery(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: climb(fs) for k, fs in items.items()}
    assert recovery.recovery(spark.createDataFrame([], schema)).count() == 0


def test_acquisition(spark):
    tracks = "item long, idx long, tag string, forced boolean, sdh boolean, fidelity long, bitmap boolean, machine boolean"
    rows = [(1, 0, "eng", False, False, 90, True, False), (1, 1, "en-GB", False, False, 90, False, False), (1, 2, "de", False, False, 80, False, True), (1, 3, "fr", False, False, 70, False, False), (1, 4, None, False, False, 99, False, False), (9, 0, "en", False, False, 1, False, False)]
    available = spark.createDataFrame(rows, tracks)
    requests = spark.createDataFrame([(1, True, "jpn"), (2, False, None)], "item long, captions boolean, audio_tag string")

    def steps(wanted, **other):
        plan = recovery.acquisition_plan(available, requests, wanted, False, False, **other).collect()
        return {k: [(x["step"], x["idx"], x["tag"]) for x in sorted(plan, key=lambda x: x["place"]) if x["item"] == k] for k in (1, 2)}

    search = [("search_exact", None, "en"), ("search_dialect", None, "en")]
    got = steps(["en"])
    assert got[1] == [("ocr_bitmap", 0, "en"), ("use_existing", 1, "en-gb"), *search, ("extract_captions", None, None), ("translate", 3, "fr"), ("transcribe", None, "ja")]
    assert got[2] == [*search, ("transcribe", None, "und")]
    assert steps(["en"], ocr=False, generate=False)[1] == [("use_existing", 1, "en-gb"), *search, ("extract_captions", None, None)]
    assert steps([], generate=False) == {1: [("extract_captions", None, None)], 2: [("unavailable", None, None)]}


def test_paired_runs(spark):
    schema = "run long, stage string, n_samples long, delayed_per_min double, mean_fps double, max_avsync_ms double, mean_cpu double, osd_ms double"
    b, c = "baseline", "composited"
    rows = [(1, b, 9, 1.0, 24.0, 5.0, 0.5, None), (1, c, 9, 4.0, 24.0, 40.0, 1.0, 100.0), (2, b, 9, 1.0, 24.0, 5.0, None, None), (2, c, 9, 4.5, 23.0, 41.0, 9.0, 101.0), (3, b, 9, 6.5, 24.0, 5.0, 0.5, None), (3, c, 9, 0.0, 24.0, 5.0, 0.5, 1.0), (4, c, 9, 0.0, 24.0, 5.0, 0.5, 1.0), (5, b, 9, 1.0, 24.0, 5.0, 0.1, None), (5, c, 9, 0.0, 30.0, 5.0, 0.7, None), (6, None, 1, None, None, None, None, None)]
    got = {x["run"]: (x["outcome"], x["findings"]) for x in recovery.paired_verdicts(spark.createDataFrame(rows, schema), 6.0, 3.0, 0.98, 40.0, 0.5, 100.0).collect()}
    fine = "late_presents_within_budget"
    assert got == {1: ("pass", [fine, "osd_in_time"]), 2: ("fail", ["late_presents", "frame_rate", "desync", "osd_slow"]), 3: ("inconclusive", ["baseline_late"]), 4: ("inconclusive", ["no_samples"]), 5: ("pass_with_notes", [fine, "cpu", "osd_not_measured"]), 6: ("inconclusive", ["no_samples"])}


def test_stable_ids(spark):
    previous = spark.createDataFrame([("a/b", 3), ("gone", 4)], "path string, id long")
    paths = spark.createDataFrame([("a b/c",), ("a/b",), ("a/c",), ("é",)], "path string")
    assert {tuple(x) for x in recovery.stable_ids(previous, paths, 5).collect()} == {("a/b", 3, False), ("a/c", 5, True), ("a b/c", 6, True), ("é", 7, True)}
    assert recovery.stable_ids(previous, paths.limit(0), 5).count() == 0


def test_folder_context(spark):
    own = "folder string, title string, year int, ids array<string>, kind string, season int, numbers array<long>, editions array<int>"
    folders = spark.createDataFrame([("f", "Blade Runner", 1982, ["x", "y", "y"], "season_only", 2, None, [3, 1]), ("short", "b", None, None, None, None, None, None), (None, "n", 1, [], None, None, None, [])], own)
    files = spark.createDataFrame([("1", "f", "br.2049", 2017, ["y"], "absolute", None, [7, 70000], [2]), ("2", "f", "br", None, None, None, None, None, None), ("3", "short", "bb", 5, ["q", "q"], "date", None, [1], [9, 1]), ("4", None, None, None, None, None, None, None, None)], "path string, " + own)
    got = {x[0]: tuple(x)[1:] for x in recovery.merge_folders(files, folders).collect()}
    assert got["1"] == ("Blade Runner", 1982, ["y", "x"], "season_episode", 2, [7, 65535], [1, 2, 3])
    assert got["2"] == ("Blade Runner", 1982, ["x", "y"], "season_only", 2, None, [1, 3])
    assert got["3"] == ("bb", 5, ["q", "q"], "date", None, [1], [1, 9])
    assert got["4"] == (None, None, [], None, None, None, [])


def test_acquisition_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(recovery, "REQUESTS_A_TASK", 10, raising=False)
    available = spark.createDataFrame([(k, 0, "en", False, False, 9, False, False) for k in range(95)], "item long, idx long, tag string, forced boolean, sdh boolean, fidelity long, bitmap boolean, machine boolean")
    plan = recovery.acquisition_plan(available, available.select("item", F.lit(False).alias("captions"), F.lit("en").alias("audio_tag")), ["en"], True, False)
    assert plan.rdd.getNumPartitions() == 10 and plan.count() == 95 * 4


def test_lines_meet_before_they_are_grouped(spark):
    plan = playback._lines(spark, "/root/testdata/sf0.001").repartition(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_orderkey#" in plan and ", l_partkey" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
