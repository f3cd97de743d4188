"""The index over passes against a plain version, and kept up by micro-batches."""

import random

import pytest

from reelspark.operators import index as ix
from reelspark.streaming.index import LibraryIndex


def plain(index, observed):
    """index: path -> record (dict); observed: path -> dict. Returns path -> (verdict, from, record or None)."""
    key = lambda p: p.split("/")
    live = {p: r for p, r in index.items() if not r["tombstoned"]}
    missing = {}
    for p in sorted(live, key=key):
        if p not in observed and live[p]["sketch"] is not None:
            missing[live[p]["sketch"]] = p
    out, claimed = {}, set()
    for p in sorted(observed, key=key):
        o, known = observed[p], live.get(p)
        made = {c: o[c] for c in ("size", "mtime", "sketch", "needs_review")} | {"tombstoned": False, "verified_at": None, "verified_digest": None, "pending": False}
        if o["gone"]:
            out[p] = ("vanished", None, None)
        elif known and (known["size"], known["mtime"]) == (o["size"], o["mtime"]):
            out[p] = ("unchanged", None, known)
        elif o["unreadable"]:
            out[p] = ("failed", None, known)
        elif known:
            out[p] = ("modified", None, made)
        elif o["sketch"] in missing:
            was = missing.pop(o["sketch"])
            claimed.add(was)
            out[p] = ("moved", was, made | {c: index[was][c] for c in ("verified_at", "verified_digest", "pending")})
        else:
            out[p] = ("new", None, made)
    for p, r in index.items():
        if p not in observed and p not in claimed:
            out[p] = ("expired", None, None) if r["tombstoned"] else ("tombstoned", None, r | {"tombstoned": True})
    return out


def some(r, observed):
    rows = {}
    for _ in range(r.randint(0, 25)):
        p = "/".join(r.choice(["a", "b", "a b", "c"]) for _ in range(r.randint(1, 3)))
        rows[p] = {"size": r.randint(0, 2), "mtime": r.randint(0, 1), "sketch": r.choice([None, "s1", "s2", "s3", "s4"]), "needs_review": r.choice([None, None, "odd"])}
        rows[p] |= {"gone": r.random() < 0.1, "unreadable": r.random() < 0.15} if observed else {"tombstoned": r.random() < 0.2, "verified_at": r.choice([None, 7]), "verified_digest": r.choice([None, "d"]), "pending": r.random() < 0.3}
    return rows


def frame(spark, rows, schema):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(({"path": p} | r)[c] for c in names) for p, r in rows.items()], schema)


@pytest.mark.parametrize("seed", range(4))
def test_reindex(spark, seed):
    r = random.Random(seed)
    index, observed = some(r, False), some(r, True)
    rows = ix.reindex(frame(spark, index, ix.INDEX_SCHEMA), frame(spark, observed, ix.OBSERVED_SCHEMA))
    got = {x["path"]: (x["verdict"], x["from_path"], {c: x[c] for c in ix.RECORD[1:]} if x["kept"] else None) for x in rows.collect()}
    want = plain(index, observed)
    assert got == want
    counts = ix.report(rows).first()
    verdicts = [v for v, *_ in want.values()]
    review = sum(v in ("new", "modified", "moved") and observed[p]["needs_review"] is not None for p, (v, *_) in want.items())
    assert counts["failed"] == verdicts.count("failed") + review and counts["moved"] == verdicts.count("moved")
    assert counts["changed"] == any(v in ("new", "modified", "moved", "tombstoned") for v in verdicts)


def test_micro_batches_in_any_split_and_again(spark, tmp_path):
    r = random.Random(11)
    start, passes = some(r, False), {1: some(r, True), 3: some(r, True)}
    passes[4] = {p: x | {"gone": False, "unreadable": False} for p, x in passes[3].items()}
    passes[5] = dict(passes[4])
    for split in (1, 4):
        live = LibraryIndex(spark, f"{tmp_path}/{split}")
        live.begin(frame(spark, start, ix.INDEX_SCHEMA))
        rows = [(n, p, x) for n, seen in passes.items() for p, x in sorted(seen.items())]
        names = [x.split()[0] for x in ix.OBSERVED_SCHEMA.split(", ")]
        size = -(-len(rows) // split)
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batch = lambda part: spark.createDataFrame([(*(({"path": p} | x)[c] for c in names), n) for n, p, x in part], f"{ix.OBSERVED_SCHEMA}, pass long")
        for k, part in enumerate(parts):
            live.observe(batch(part), k)
            if k == 1:  # the same batch once more, by another object, as after a restart
                LibraryIndex(spark, f"{tmp_path}/{split}").observe(batch(part), k)
        live.close(5)
        live.close(5)
        index, version = start, 0
        versions = [(0, 0)]
        for n, seen in passes.items():
            found = plain(index, seen)
            version += any(v in ("new", "modified", "moved", "tombstoned") for v, *_ in found.values())
            versions.append((n, version))
            index = {p: x for p, (_, _, x) in found.items() if x is not None}
        assert {x["path"]: {c: x[c] for c in ix.RECORD[1:]} for x in live.index().collect()} == index
        assert sorted((x["pass"], x["version"]) for x in live.log().collect()) == versions
        assert versions[-1][1] == versions[-2][1]  # the last pass observed the same files
