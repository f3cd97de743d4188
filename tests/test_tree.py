"""Trees, roots and ranges against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators import ranges, tree

ODD = ["a", "a b/x", "a/b", "a/b/c", "a/b/c/d", "a/é/1", "a//b/2", "/lead/3", "b", "b/BDMV/1", "b/2", "b c/VIDEO_TS/1", "b!/3", "b/d/VIDEO_TS/x/4", "BDMV/5", "c/BDMV", None, "", "//", "a/b/c/d", "\x01/0/1", "~/z"]


def plain_tree(files):
    known = {}
    for path, size in files:
        parts = tuple(x for x in (path or "").split("/") if x)
        if parts:
            known[parts] = max(known.get(parts, 0), size or 0)
    folders = {}
    for parts, size in known.items():
        for k in range(len(parts)):
            n, total = folders.get(parts[:k], (0, 0))
            folders[parts[:k]] = (n + 1, total + size)
    out, at = [], 0

    def walk(folder, ordinal):
        nonlocal at
        at += 1
        begin, row = at, len(out)
        out.append(None)
        subs = sorted((p for p in folders if len(p) == len(folder) + 1 and p[:-1] == folder), key=lambda p: p[-1].encode())
        own = sorted((p for p in known if len(p) == len(folder) + 1 and p[:-1] == folder), key=lambda p: p[-1].encode())
        for k, p in enumerate(own):
            at += 1
            out.append(("/".join(p), "file", len(p), at, at, len(subs) + k + 1, 1, known[p]))
        for k, p in enumerate(subs):
            walk(p, k + 1)
        out[row] = ("/".join(folder), "folder", len(folder), begin, at, ordinal, *folders[folder])

    if folders:
        walk((), 1)
    return out


@pytest.mark.parametrize("n", [1, 3, 7])
def test_tree(spark, n):
    r = random.Random(n)
    files = [(p, i) for i, p in enumerate(ODD)] + [("/".join(r.choice("abcA ~é") for _ in range(r.randint(1, 5))), None if i % 7 == 0 else i) for i in range(60)]
    frame = spark.createDataFrame([(p, s, 1) for p, s in files], "path string, size long, parts int")
    got = [tuple(x) for x in tree.browse_tree(frame, n).orderBy("begin").collect()]
    assert got == plain_tree(files)
    below = [x["path"] for x in tree.subtree(tree.browse_tree(frame, n), "a").collect()]
    assert below == [x[0] for x in got if x[0].startswith("a/") or (x[0], x[1]) == ("a", "folder")]


def test_no_files(spark):
    empty = spark.createDataFrame([], "path string, size long")
    assert tree.browse_tree(empty).collect() == [] and tree.collapse_discs(empty).collect() == []


@pytest.mark.parametrize("n", [1, 5])
def test_roots(spark, n):
    r = random.Random(n)
    some = ["/".join(r.choice(["a", "a b", "b", "a!"]) for _ in range(r.randint(1, 5))) for _ in range(80)]
    roots = [*some[:12], "a", "a b", "a/a", "zz"]
    files = some + ["a", "a b/a", None, "zz/1", "zz/1"]
    got = tree.enclosing_root(spark.createDataFrame([(x, "x") for x in files], "path string, open string"), spark.createDataFrame([(x,) for x in roots], "root string"), n).select("path", "root").collect()
    best = lambda f: max((x for x in roots if f == x or f.startswith(x + "/")), key=len, default=None) if f is not None else None
    assert sorted(((x["path"], x["root"]) for x in got), key=repr) == sorted(((f, best(f)) for f in files), key=repr)


def test_discs(spark):
    files = [(p, 10) for p in ODD if p is None or p.strip("/")]
    got = sorted((tuple(x) for x in tree.collapse_discs(spark.createDataFrame(files, "path string, size long"), 3).collect()), key=repr)
    discs = {"b": 3, "b c": 1}
    want = [(p, "disc", n, 10 * n) for p, n in discs.items()] + [(p, "file", 1, 10) for p, _ in files if p is None or p.lstrip("/").split("/")[0] not in discs or p == "b"]
    want = [x for x in want if x[0] != "b" or x[1] == "disc"]
    want = [(p, k, n + (p == "b"), s + 10 * (p == "b")) if k == "disc" else (p, k, n, s) for p, k, n, s in want]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("path,root,want", [("a/b", "a", True), ("ab", "a", False), ("a/../b", "a", False), ("a/./b//c/..", "a/b", True), ("../a", "a", False), ("a", "a/", True), (None, "a", False), ("x", "", True), ("a/../../a/b", "a", False)])
def test_contained(spark, path, root, want):
    row = spark.createDataFrame([(path, root)], "p string, r string").select(paths.contained(F.col("p"), F.col("r")))
    assert row.first()[0] is want


@pytest.mark.parametrize("n", [1, 2, 9])
def test_lag_and_shares_over_ranges(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, 1, 1, 1, 1, 2]), i, r.choice([None, r.randint(0, 9)])) for i in range(300)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "key int, at int, v int")
    by_key = {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        by_key.setdefault(k, []).append((i, v))
    want = {(k, i, v): before for k, own in by_key.items() for (i, v), before in zip(own, [None, *(v for _, v in own)], strict=False)}
    assert {(x["key"], x["at"], x["v"]): x["before_v"] for x in ranges.lagged(frame, "key", ["at"], ["v"], n).collect()} == want
    share = {k: sorted((v for _, v in own), key=lambda v: (v is not None, v or 0))[min(len(own) * 95 // 100, len(own) - 1)] for k, own in by_key.items()}
    found = ranges.at_share(frame, "key", "v", "p95", 95, 100, n)
    assert {x["key"]: x["p95"] for x in found.collect()} == share
    assert "windowspecdefinition(key" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_key_spans_ranges(spark):
    frame = spark.range(2000).select(F.lit(1).alias("key"), F.col("id").alias("at"), (F.col("id") % 50).alias("v"))
    assert ranges.with_range(frame, ["key", "at"], 8).select("range_").distinct().count() == 8
