"""Tokens, packing, fingerprints, media, rules and licenses against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reelspark.llm import byte_bpe, fingerprint, flac, license_scan, packing, url_rules
from tests.llm.data import documents, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(900, "x" * 3000), (901, "it's we'll they've  \n\n 12345 --- " * 90), (902, "日本語" * 700), (903, "a" * 40 + " " * 900 + "b"), (904, "<|endoftext|> \x00 𝄞é"), (905, "end <|endoftext|> here one<|startoftext|>two, x<|endoftext|>. <|ENDOFTEXT|> <|endoftext|<|endoftext|>")]


@pytest.mark.parametrize("chunk,overlap", [(16384, 512), (64, 32), (50, 50), (200, 1)])
def test_byte_bpe_is_the_library_s(spark, chunk, overlap):
    rows = texts(20) + ODD
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = Counter((i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    coded = byte_bpe.encode_documents(documents(spark, rows), RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = byte_bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == Counter((i, (t or "").encode()) for i, t in rows)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    rows = texts(30) + ODD
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in rows)
    pieces = packing.pack(documents(spark, rows), path, ranges=3).collect()
    places, ids = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = np.frombuffer(p["ids"], "<u2")
        assert len(own) == p["length"] and zlib.crc32(own.astype("<u4").tobytes()) == p["ids_crc32"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        ids[p["doc_id"], p["doc_tokens"]].append((p["sequence_id"], p["offset"], p["start"], tuple(own.tolist())))
    full = sorted(places)
    assert full == list(range(len(full)))
    for s, held in places.items():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 4096 and (at == 4096 or s == full[-1])
    found = Counter()
    for (i, _), some in ids.items():
        doc = []
        for _, _, start, part in sorted(some):
            if start == 0 and doc:
                found[i, tuple(doc)] += 1
                doc = []
            doc += part
        found[i, tuple(doc)] += 1
    assert found == want


def test_hilbert_key_is_a_walk():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_fingerprints(spark):
    rows = [(i, t) for i, t in texts(30) if i is not None] + ODD
    rows = sorted({i: t for i, t in rows}.items())
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, cut = t or "", len(t or "") // 4
        edited = t[: len(t) - cut] + (after or "")[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1 and len(got[i]["fingerprint"]) <= 16 * fingerprint.K
    assert got[200]["fingerprint"] == got[201]["fingerprint"]
    assert fingerprint.fingerprint_documents(documents(spark, [])).collect() == []


def test_sketches_estimate_and_merge(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    row = row.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(fingerprint.merge(F.col("a"), F.col("b"))).alias("u")).first()
    assert abs(row["j"] - 0.5) < 0.15 and abs(row["n"] - 2996) < 900 and abs(row["c"] - 0.667) < 0.2 and abs(row["u"] - 3996) < 1200


def test_media_round_trip(spark):
    rows = texts(20) + ODD
    got = {(r["doc_id"], r["payload_sha256"]): r for r in flac.media_digests(documents(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i, hashlib.sha256(padded).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["verified"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]), True)


def test_media_finds_damage():
    data = bytes(range(256)) * 40
    stream = flac.write([data])[0]
    ok, error, blocks = flac.read([stream])[0]
    assert ok and error is None and b"".join((x + 128).astype(np.uint8).tobytes() for _, x in blocks) == data
    for at in (0, 30, 100, len(stream) // 2, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 0x11
        assert not flac.read([bytes(broken)])[0][0]
    assert flac.read([b"", stream[:60], stream[:-5]])[1][0] is False


def test_url_rules(spark):
    urls = ["http://A.Example.net/en/x?q#f", "https://example.net/", "x.net/en/", None, "ftp://net", "http://org/fr/1", "http://a.b.org/fr/", "http://org/de", "http://example.com/de/", "http://notexample.com/de/", "://example.com/de/x#://net/", "http://exampleXnet/en/"]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for ranges in (1, 7):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules, ranges=ranges).collect()}
        assert [got[k] for k in range(len(urls))] == [("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow"), ("org/fr/", "allow"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"), ("example.com/de/", "block"), (None, "allow")]
    assert url_rules.judge_urls(pages.filter("false"), rules).collect() == []


def test_licenses_are_found(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    templates = spark.createDataFrame([("mit", "Released under the MIT License."), ("grant", grant), ("re", "All rights reserved."), ("again", "go on " * 12), ("none", None), ("blank", " ")], "template_id string, text string")
    rows = texts(40)
    rows += [(500 + k, "word " * k + grant.upper() + " and " + "tail " * (k % 7)) for k in range(40)]
    rows += [(600, "x released under the mit license, all rights reserved"), (601, "released under the MIT"), (602, grant.replace("free", "gratis")), (603, "go on " * 30), (604, "free of charge, to any person obtaining a copy of this")]
    got = defaultdict(dict)
    for r in license_scan.scan(documents(spark, rows), templates).collect():
        got[r["doc_id"]][r["template_id"]] = r
    for k in range(40):
        m = got[500 + k]["grant"]
        assert (m["first_word"], m["n_words"], m["containment"]) == (k, 20, 1.0)
    assert set(got) == {*range(500, 540), 600, 603} and set(got[600]) == {"mit", "re"} and set(got[603]) == {"again"}


def test_license_bands_keep_their_promise():
    assert 1 - (1 - 0.4) ** license_scan.bands_for(0.4, 0.9999) >= 0.9999


def _shingles(text):
    words = [w.decode() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_fingerprints_against_whole_sets(spark):
    rows = sorted({i: t for i, t in texts(60) if i is not None}.items())
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(documents(spark, rows)).collect()}
    exact = 0
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, cut = t or "", len(t or "") // 4
        own = _shingles(t)
        for name, other in (("near_edited", _shingles(t[: len(t) - cut] + (after or "")[:cut])), ("near_next", _shingles(after))):
            union = own | other
            want = len(own & other) / len(union) if union else 1.0
            if len(union) <= fingerprint.K:
                assert got[i][name] == pytest.approx(want, abs=1e-12), (i, name)
                exact += 1
            else:
                assert got[i][name] == pytest.approx(want, abs=0.2), (i, name)
        if len(own) < fingerprint.K:
            assert got[i]["distinct_shingles"] == len(own) and len(got[i]["fingerprint"]) == 16 * len(own)
        else:
            assert got[i]["distinct_shingles"] == pytest.approx(len(own), rel=0.4)
    assert exact > 60


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here are these six"), (2, None), (2, ""), (None, "x y z"), (None, None), (900, "far away")]
    got = fingerprint.fingerprint_documents(documents(spark, rows)).collect()
    lengths = Counter((r["doc_id"], r["n_chars"]) for r in got)
    assert lengths == Counter((i, len(t or "")) for i, t in rows)
    prints = {r["fingerprint"] for r in got if (r["doc_id"], r["n_chars"]) == (1, 11)}
    assert len(prints) == 1
    assert fingerprint.fingerprint_documents(documents(spark, [])).collect() == []
