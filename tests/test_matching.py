"""Ranked candidates against every pair scored by a loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reelspark.operators import matching

COLUMNS = "id long, title string, year int, runtime long, popularity double, alternates array<string>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def similar(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, pool = a.split(), b.split()
    size, shared = len(x) + len(pool), 0
    for w in x:
        if w in pool:
            pool.remove(w)
            shared += 1
    longest, d = max(len(a), len(b)), distance(a, b)
    return max(2 * shared / size, 1 - d / longest if d <= longest * 2 // 5 else 0.0)


def score(q, c):
    whole, total = 1.05, max(similar(q[1], t) for t in [c[1], *(c[5] or [])]) + 0.05 * min(max((c[4] or 0) / 100, 0), 1)
    if q[2] is not None and c[2] is not None:
        whole, total = whole + 0.35, total + 0.35 * {0: 1, 1: 0.7, 2: 0.3}.get(abs(q[2] - c[2]), 0)
    if q[3] is not None and c[3] is not None:
        off = abs(q[3] - c[3]) / min(q[3], c[3]) if q[3] and c[3] else 9
        whole, total = whole + 0.45, total + 0.45 * (1 if off <= 0.02 else 0 if off >= 0.25 else (0.25 - off) / 0.23)
    return round(total / whole, 6)


@pytest.mark.parametrize("seed", range(2))
def test_candidates_like_a_loop(spark, seed):
    r = random.Random(seed)
    words = ["blue", "moon", "moons", "a", "ab", "rocky", "2", "golden", "goldne", "xyz", "river", "rivers"]

    def name():
        return " ".join(r.choice(words) for _ in range(r.choice([0, 1, 1, 2, 2, 3])))

    rows = [(k, name(), r.choice([None, 1990, 1991, 1992, 2000]), r.choice([None, 0, 100, 101, 103, 120, 500]), r.choice([None, 0.0, 70.0, 100.0, 400.0]), r.choice([None, None, [], [name()]])) for k in range(70)]
    check(spark, rows, loop(rows))


def test_candidates_of_a_hot_title_like_a_loop(spark):
    r = random.Random(9)
    titles = ["blue moon"] * 12 + ["blue moons", "blue river", "the blue moon rises", "golden river"]
    rows = [(k, r.choice(titles), r.choice([None, *range(1990, 1996)]), r.choice([None, 0, *range(5000, 6500, 40)]), float(r.randrange(100)), None) for k in range(400)]
    rows += [(1000 + k, "blue moon", 1991, 5200, r.choice([70.0, 70.001, 70.0001, 50.0]), None) for k in range(40)]
    check(spark, rows, loop(rows))


def loop(rows):
    want = {}
    for q in rows:
        best = sorted((-s, c[0]) for c in rows if c[0] != q[0] and (s := score(q, c)) >= 0.45)[:5]
        for place, (s, c) in enumerate(best, 1):
            margin = round(-best[0][0] + (best[1][0] if len(best) > 1 else 0), 6)
            want[q[0], place] = (c, -s, margin, "matched" if -best[0][0] >= 0.8 and (len(best) == 1 or margin > 0.08) else "ambiguous")
    return want


def check(spark, rows, want):
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {(x["query"], x["place"]): (x["candidate"], x["score"], x["margin"], x["verdict"]) for x in matching.ranked_candidates(frame, frame, itself=False).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][1:3] == pytest.approx(want[k][1:3], abs=2e-6) and (got[k][0], got[k][3]) == (want[k][0], want[k][3])


def test_whole_candidates_of_other_blocks_and_without_runtime(spark):
    rows = [(1, "blue moon", None, None, None, None), (4, "blue moon", None, 100, None, None), (5, "zq", 1990, 100, 100.0, None), (6, "kkkk", 1990, 101, None, None)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {(x["query"], x["candidate"]): (x["score"], x["verdict"]) for x in matching.ranked_candidates(frame, frame, itself=False).collect()}
    assert got == {(1, 4): (0.952381, "matched"), (4, 1): (0.952381, "matched"), (6, 5): (0.459459, "ambiguous")}


def test_shelves_are_not_sent_whole_through_the_driver(spark):
    # a range has a known small size, as a small file has
    c = spark.range(9).selectExpr("id AS candidate", "CAST(1990 + id AS INT) AS c_year", "100 + id AS c_runtime", "CAST(id AS DOUBLE) AS popularity", "array('blue moon') AS names")
    shelves = matching._shelves(c)
    probed = shelves.select(F.col("candidate").alias("key"), F.col("c_year").alias("q_year"), F.col("c_runtime").alias("q_runtime"), F.lit(1.0).alias("similar"), *matching._SHELF)
    pairs = matching._scores(probed, shelves)
    assert pairs.count() > 0 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_best_of_a_block_like_a_loop_and_without_all_pairs(spark, seed):
    r = random.Random(seed)
    titles = ["old bolt", "cold bolt", "old ring", "old old ring", "bolt", "ring of", "", "hot", "hut", None]
    rows = [(k, r.choice(titles), r.choice([None, 0, -5, 7, *range(900, 1000, 3), 1200]), r.choice([1, 1, 2, None])) for k in range(400)] + [(900 + k, "old bolt", 950, 1) for k in range(9)]
    rows += [(950, "old ring", 950, 2), (950, "old ring", 950, 2), (None, "old ring", 950, 2)]

    def like(a, b):
        if not a or not b:
            return 0.0
        x, y, longest, d = set(a.split()), set(b.split()), max(len(a), len(b)), distance(a, b)
        return 1.0 if a == b else max(2 * len(x & y) / (len(x) + len(y)), 1 - d / longest if d <= longest * 2 // 5 else 0.0)

    def agree(a, b):
        if a is None or b is None or not min(a, b):
            return 0.0
        off = abs(a - b) / min(a, b)
        return 1 if off <= 0.02 else 0 if off >= 0.25 else (0.25 - off) / 0.23

    similar_ = {(a, b): like(a, b) for a in titles for b in titles}
    pairs = {}
    for q in rows:
        for c in rows:
            if None not in (q[0], c[0], q[1], c[1], q[3]) and q[3] == c[3] and q[0] != c[0] and (s := round(0.7 * similar_[q[1], c[1]] + 0.3 * agree(q[2], c[2]), 6)) >= 0.45:
                pairs.setdefault(q[0], []).append((-s, c[0]))
    want = {}
    for q, found in pairs.items():
        found.sort()
        gap = round(-found[0][0] + (found[1][0] if len(found) > 1 else 0), 6)
        want[q] = (found[0][1], -found[0][0], gap, "matched" if -found[0][0] >= 0.8 and (len(found) == 1 or gap > 0.08) else "ambiguous")
    frame = spark.createDataFrame(rows, "id long, title string, runtime long, block int")
    out = matching.best_candidates(frame, frame, ["block"])
    got = {x["query"]: tuple(x)[1:] for x in out.collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][1:3] == pytest.approx(want[k][1:3], abs=2e-6) and (got[k][0], got[k][3]) == (want[k][0], want[k][3])


def test_equal_rows_of_a_block_are_not_paired(spark):
    """20,000 rows of one block, title and runtime would be 400 million pairs."""
    frame = spark.range(20_000).select("id", F.lit("old bolt").alias("title"), F.lit(950).alias("runtime"), F.lit(1).alias("block"))
    out = matching.best_candidates(frame, frame, ["block"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Join \[block#\d+\]", plan) == [] and "c_title" in plan
    assert out.groupBy("candidate", "score").count().orderBy("candidate").collect() == [(0, 1.0, 19_999), (1, 1.0, 1)]
