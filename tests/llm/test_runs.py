"""Runs of words against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import periodic_runs, queries
from tests.llm.data import documents, texts


def plain_runs(words, least, exponent):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted((s, k, q) for s, k, q in found if not any(p < q and t <= s and s + k <= t + m for t, m, p in found)), n


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("least,exponent", [(24, 3), (4, 2), (6, 2), (9, 3)])
def test_runs_of_random_words(least, exponent):
    r = random.Random(least * 10 + exponent)
    for trial in range(60):
        rows = []
        for _ in range(r.randint(1, 4)):
            words = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(0, 70))]
            if r.random() < 0.7 and words:
                unit = words[: r.randint(1, 9)]
                words = words[: r.randint(0, 20)] + unit * r.randint(2, 12) + unit[: r.randint(0, len(unit))] + words
            rows.append(words)
        codes = np.array([w for x in rows for w in x], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        got = sorted(zip(*(x.tolist() for x in periodic_runs.runs(codes, offsets, least, exponent)), strict=True))
        want = sorted((s + int(o), k, q) for x, o in zip(rows, offsets, strict=False) for s, k, q in plain_runs(x, least, exponent)[0])
        assert got == want, (trial, rows)


def test_digests_of_whole_texts(spark):
    r = random.Random(3)
    rows = texts(60)[:-1] + [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 300)))) for i in range(1000, 1100)]
    rows += [(300, "x " * 5000), (301, "日 本 語  " * 40), (302, "\x00a b\x1f " * 30), (303, ("a " * 30 + "b ") * 6)]
    frame = periodic_runs.run_digests(periodic_runs.with_planted_periods(documents(spark, rows)))
    got = Counter(tuple(x) for x in frame.collect())
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        words = planted(i, words)
        found, n = plain_runs(words, 24, 3)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = None
        for s, m, q in found:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[i, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert any(x[1] > 1 for x in got)


def test_no_rows(spark):
    assert queries.periodic_runs.run_digests(documents(spark, [])).collect() == []
