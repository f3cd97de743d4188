"""Substring dedup, n-gram join and components against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelspark.llm import ngram_join, substring_dedup
from reelspark.llm.components import components
from tests.llm.data import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_dedup(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("window,anchor,hot", [(35, 8, 64), (35, 8, 2), (10, 4, 3), (5, 5, 2)])
def test_dedup_is_exact(spark, window, anchor, hot):
    rows = texts()
    got = substring_dedup.remove_repeats(documents(spark, rows).repartition(5), window, anchor, hot_at=hot).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_dedup(rows, window)
    assert all(sum(s["n_words"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_rows_that_share_an_id_keep_their_own_words(spark):
    long = " ".join(f"pw{k}" for k in range(60))
    rows = [(None, "tiny b110646"), (None, f"{long} a101472"), (1, f"{long} other end"), (7, long), (7, "x " + long), (7, None), (7, "")]
    got = substring_dedup.remove_repeats(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_dedup(rows, 35)


def test_repeated_rows_by_the_thousand(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(k % 3, text) for k in range(6000)] + [(9, text[:900] + " new"), (10, "alone " * 3)]
    got = substring_dedup.remove_repeats(documents(spark, rows).repartition(6)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_dedup(rows, 35)


def test_factors_are_the_longest():
    """Against a plain greedy parse."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        width, window = 14, 5
        words = rng.integers(0, 3, (rng.integers(2, 9), width)).astype(np.uint64)
        asked = rng.random(len(words)) < 0.8
        want = set()
        for i in np.flatnonzero(asked):
            at = 0
            while at + window <= width:
                n = max(next((m for m in range(width - at) if words[i, at + m] != words[j, at + m]), width - at) for j in range(len(words)) if j != i)
                if n >= window:
                    want.add((i, at, n))
                at = at + n - window + 1 if n >= window else at + 1
        assert set(zip(*(x.tolist() for x in substring_dedup.greedy_factors(words, asked, window)), strict=True)) == want


def test_dedup_of_nothing(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(documents(spark, []), carry=("kept",))


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g].append(i)
    return Counter((i, len(s), min(least[g]) if least[g] else None) for (i, _), s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize("n,num,den,block,hot", [(3, 90, 100, 512, 10_000), (5, 4, 5, 512, 3), (3, 6, 10, 2, 10_000), (1, 1, 2, 1, 4), (2, 1, 1, 8, 2)])
def test_join_is_exact(spark, n, num, den, block, hot):
    rows = texts(90)
    got = ngram_join.similarity_components(documents(spark, rows), n, num, den, block, hot).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, n, num, den)


def test_thousands_of_near_copies_are_one_component(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*base[:40], f"x{k}", *base[41:]])) for k in range(1500)]
    rows += [(3000 + k, " ".join(["far", *base[1:60], f"y{k % 7}", f"z{k}"])) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(documents(spark, rows), 3, 9, 10, block=100, hot=500).collect()}
    assert {got[k] for k in range(1500)} == {0} and got == {i: c for i, _, c in brute_components(rows[:3] + rows[1500:], 3, 9, 10)} | {k: 0 for k in range(1500)}


def test_join_of_nothing(spark):
    assert ngram_join.similarity_components(documents(spark, []), 3, 9, 10).collect() == []


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_always_meet(num, den):
    """Sets at the threshold share a prefix member, however the differing members fall and whatever the order, and the tries find them."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 100, 333]:
        for _ in range(30):
            pool = rng.integers(0, 2**64, 2 * size + 2, dtype=np.uint64)
            a = np.unique(pool[:size])
            drop, add = rng.integers(0, size + 1), rng.integers(0, size + 1)
            b = np.unique(np.concatenate([a[drop:], pool[size : size + add]]))
            both = len(np.intersect1d(a, b))
            linked = both and den * both >= num * (len(a) + len(b) - both)
            i, _ = ngram_join._linked([a], [b], num, den) if len(b) else ([], [])
            assert len(i) == bool(linked)
            if linked:
                common = rng.permutation(pool)[: rng.integers(0, len(pool))]
                order = ngram_join.Order(common, rng.integers(1, 9, len(common)))
                assert np.isin(*ngram_join.prefixes([a, b], order, num, den)).any()
                x, y = ([np.array([len(s)]), np.array([k]), [ngram_join.sketch(s)]] for k, s in enumerate((a, b)))
                assert all(m.all() for m in ngram_join.may_link(*x, *y, num, den))


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(300, 300), (1, 2), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(200, 260)} == {7} and got[2] == 1 and 300 not in got
