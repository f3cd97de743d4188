"""Licenses in edited texts, at every place."""

from collections import defaultdict

from reelspark.llm import license_scan
from tests.llm.data import documents

NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'.split()


def test_edited_copies_are_found_at_every_place(spark):
    templates = spark.createDataFrame([("notice", " ".join(NOTICE)), ("again", "go on " * 12)], "template_id string, text string")
    middle, rows = len(NOTICE) // 2, []
    for inserted in (0, 12, 20):
        for place in range(30):
            words = [f"lead{k}" for k in range(place)] + NOTICE[:middle] + [f"new{k}" for k in range(inserted)] + NOTICE[middle:] + ["tail"] * 70
            rows.append((inserted * 100 + place, " ".join(words)))
    rows += [(9000, " ".join(NOTICE * 2)), (9001, "x " + "go on " * 24 + "y"), (9002, " ".join(NOTICE[:15]) + " gap" * 40 + " " + " ".join(NOTICE[15:]))]
    got = defaultdict(list)
    for r in license_scan.scan(documents(spark, rows), templates).collect():
        got[r["doc_id"]].append((r["template_id"], r["first_word"], r["n_words"], round(r["containment"], 6)))
    n, shingles = len(NOTICE), len(NOTICE) - 4
    for inserted in (0, 12, 20):
        for place in range(30):
            share = round((shingles - 4 * (inserted > 0)) / shingles, 6)
            assert got[inserted * 100 + place] == [("notice", place, n + inserted, share)]
    assert sorted(got[9000]) == [("notice", 0, n, 1.0), ("notice", n, n, 1.0)]
    assert sorted(got[9001])[0] == ("again", 1, 24, 1.0)
    assert 9002 not in got  # longer than the span


def test_bands_keep_their_promise_at_the_least_resemblance():
    for shingles in (1, 7, 26, 400):
        words = [str(k) for k in range(shingles + 4)]
        made = license_scan._prepare([("t", " ".join(words))], 5, 0.8, 0.9999)[0]
        held = -(-shingles * 4 // 5)
        assert 1 - (1 - held / (4 * shingles - held)) ** len(made.family) >= 0.9999
