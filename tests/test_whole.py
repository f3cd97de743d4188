"""Survey methods in full: quiet periods, offsets, stages, calibration, pages and merges, by hand or like a loop."""

import random
from collections import defaultdict

import pytest

from reelspark.operators import library, metadata, subtitles
from reelspark.plans import statistics
from reelspark.streaming import changes


def test_events_in_the_quiet_period_are_discarded(spark):
    rows = [(1, t) for t in (0, 1000, 2500, 4001, 5499, 5500, 9000)] + [(2, 0), (2, 2999), (2, 3000), (None, 7), (3, None)]
    got = {tuple(r) for r in changes.debounce_quiet(spark.createDataFrame(rows, "key long, at_ms long")).collect()}
    assert got == {(1, 0, 2500, 3), (1, 5500, 5500, 1), (1, 9000, 9000, 1), (2, 0, 0, 1), (2, 3000, 3000, 1), (None, 7, 7, 1)}


def test_offsets_like_a_loop(spark):
    r = random.Random(4)
    cues = [(k, r.randint(0, 9000)) for k in (1, 2, 3) for _ in range(30)] + [(4, 0), (5, 3)]
    speech = [(k, at - 730 + r.randint(0, 40)) for k, at in cues if k < 3 and r.random() < 0.8] + [(3, r.randint(0, 9000)) for _ in range(25)] + [(4, -25), (4, 25), (6, 1)]
    want = {}
    for k in (1, 2, 3, 4):
        buckets = defaultdict(list)
        for d in (s - c for j, c in cues if j == k for i, s in speech if i == k):
            if abs(d) <= 3000:
                buckets[d // 50].append(d)
        _, best = max(buckets.items(), key=lambda x: (len(x[1]), -abs(x[0]), x[0]))
        want[k] = (sorted(best)[len(best) // 2], len(best))
    frames = [spark.createDataFrame(x, "track long, at long") for x in (cues, speech)]
    assert {x["track"]: (x["offset_ms"], x["n_pairs"]) for x in subtitles.estimate_offsets(*frames, window_ms=3000).collect()} == want


def test_stages(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0, 90, 9, 1.0, 9.0, 999.0, 1.0), ("a", 1000, 10, 5, 24.0, -0.03, 4.0, 0.5), ("a", 11000, 12, 3, nan, 0.01, None, None), ("a", 31000, 16, 2, -1.0, inf, 7.0, 0.25), ("a", 31000, 16, 2, 26.0, 0.0, inf, nan)]
    rows += [("b", 5000, 1, 1, 24.0, 0.5, 1.0, 0.5), ("c", 10, 1, 1, 24.0, 0.5, 1.0, 0.5)]
    frame = spark.createDataFrame(rows, "stage string, at_ms long, delayed long, dropped long, fps double, avsync_s double, render_ms double, cpu_frac double")
    got = {r[0]: tuple(r)[1:] for r in statistics.stage_summary(frame, 1000).collect()}
    assert got["a"] == pytest.approx((4, 30.0, 6, 0, 12.0, 25.0, 30.0, 7.0, 0.375))
    assert got["b"] == (1, 0.0, 0, 0, 0.0, 0.0, 0.0, None, None) and got["c"] == (0, 0.0, 0, 0, 0.0, 0.0, 0.0, None, None)


def test_calibration_has_three_states(spark):
    rows = [(True, "no", 3, 2.0, 50.0, None, "spdif-ac3"), (True, "vaapi", 2, 2.0, 50.0, True, "spdif-ac3"), (False, "", 9, 1.9, 50.0, True, "s16"), (None, "vaapi", 9, 9.0, 0.0, False, None), (True, None, None, 9.0, 24.0, False, "s16")]
    frame = spark.createDataFrame(rows, "predicted_hardware_decode boolean, observed_hwdec string, dropped_frames long, seconds_played double, expected_fps double, predicted_audio_passthrough boolean, observed_audio_out_format string")
    assert {tuple(r) for r in statistics.calibration_checks(frame).collect()} == {("hardware_decode", 5, 3, 2, 1), ("drop_rate", 5, 2, 1, 1), ("audio_passthrough", 5, 3, 2, 1)}


def test_pages(spark):
    files = spark.createDataFrame([(f"{k % 3}/{k}",) for k in range(9)], "path string")
    ordered = sorted(f"{k % 3}/{k}" for k in range(9))
    for start, count in ((0, 4), (4, 4), (8, 4), (3, 0)):
        got = [(r["path"], r["total"]) for r in library.page(files, start, count).orderBy("position").collect()]
        assert got == [(p, 9) for p in (ordered[start : start + count] if count else ordered[start:])]


def test_merge_with_sources_base_and_locks(spark):
    base = [(1, "t", "title", "mine", 0, None, None, True), (1, "t", "sort", "side", 2, None, None, False), (1, "d", "plot", "old", 1, "q", 0, False), (1, "d", "only", "kept", 0, None, None, False)]
    new = [(1, "t", "title", "user", 3, None), (1, "t", "sort", "tmdb", 1, "p"), (1, "d", "plot", "better", 1, "p"), (1, "d", "plot", " \t", 3, None), (1, "a", "art", "x", 1, "p"), (1, "a", "art", "y", 1, "q"), (1, "d", "new", "b", 1, "z"), (1, "d", "new", "c", 1, "y")]
    rank = [(None, "p", 0), (None, "q", 1), ("a", "q", 0)]
    got = metadata.merge_fragments(
        spark.createDataFrame(base, "item long, field_group string, name string, value string, kind int, provider string, rank int, locked boolean"),
        spark.createDataFrame(new, "item long, field_group string, name string, value string, kind int, provider string"),
        spark.createDataFrame(rank, "field_group string, provider string, pos int"),
    )
    assert {(r["name"], r["value"], r["provider"]) for r in got.collect()} == {("title", "mine", None), ("sort", "side", None), ("plot", "old", "q"), ("only", "kept", None), ("art", "y", "q"), ("new", "b", "z")}
