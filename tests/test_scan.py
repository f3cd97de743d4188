"""Signatures, kinds, pruning and notes by hand, and the scan's queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import signatures
from reelspark.operators import scan
from reelspark.plans import queries
from tests.compare import differences

PACKET = b"G" + b"x" * 187


@pytest.mark.parametrize("name", ["sniffed", "scan_files", "scan_candidates"])
def test_queries_like_their_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001") == []


def test_signatures(spark):
    heads = {
        b"": "RawElementaryStream:0",
        b"\x1a\x45\xdf\xa3....": "Matroska:2,RawElementaryStream:0",
        b"\x1a\x45\xdf\xa3....\x42\x82\x84webm": "WebM:2,Matroska:2,RawElementaryStream:0",
        b"RIFF....WAVE": "RawElementaryStream:1",
        b"RIFF....AVI ": "Avi:2,RawElementaryStream:0",
        b"RIFF": "Avi:1,RawElementaryStream:0",
        b"....ftypiso5": "FragmentedMp4:2,RawElementaryStream:0",
        b"....ftypqt  iso5": "Mp4:2,RawElementaryStream:0",
        b"....ftypisom....xxxxiso6": "FragmentedMp4:2,RawElementaryStream:0",
        b"....ftypisom....xxxxiso": "Mp4:2,RawElementaryStream:0",
        b"....moovmoov": "Mp4:1,RawElementaryStream:0",
        b"....moov": "RawElementaryStream:0",
        b"ID3" + b"\x00" * 20 + PACKET * 4: "RawElementaryStream:1,MpegTs:1",
        PACKET * 4: "MpegTs:2,RawElementaryStream:0",
        PACKET * 3: "RawElementaryStream:0",
        (PACKET + b"\n\xff\x00\xe9") * 4: "MpegTs:2,RawElementaryStream:0",
        b"\x00\x00\x00\x01": "RawElementaryStream:2",
    }
    rows = spark.createDataFrame([(bytearray(h), want) for h, want in heads.items()] + [(None, "RawElementaryStream:0")], "head binary, want string")
    shown = F.array_join(F.transform(signatures.candidates(F.col("head")), lambda x: F.concat(x["container"], F.lit(":"), x["confidence"])), ",")
    for r in rows.withColumn("got", shown).collect():
        assert r["got"] == r["want"], r


def test_extension_decides_between_equals_only(spark):
    row = spark.createDataFrame([([("WebM", 2), ("Matroska", 2), ("Mp4", 1), ("Raw", 0)],)], "found array<struct<container: string, confidence: int>>")
    order = lambda e: [x["container"] for x in row.select(signatures.ranked(F.col("found"), F.lit(e).cast("string")).alias("r")).head()["r"]]
    assert order("mkv") == ["Matroska", "WebM", "Mp4", "Raw"]
    assert order("mp4") == order(None) == order("zzz") == ["WebM", "Matroska", "Mp4", "Raw"]


def test_scan_of_odd_rows(spark):
    mkv, none = bytearray(b"\x1a\x45\xdf\xa3"), bytearray(b"plain")
    rows = [
        ("a/film.mkv", 2_000_000, False, mkv, False, "film"),
        ("a/film.mkv", 2_000_000, None, mkv, None, "film"),
        ("a/film.mp4", 2_000_000, False, mkv, False, "film"),
        ("a/notes", 10, False, none, False, "notes"),
        ("a/film", 2_000_000, False, mkv, False, ""),
        ("a/x.srt", 0, False, mkv, False, "x"),
        ("a/.x.mkv", 5, False, mkv, False, "x"),
        ("a/s.mkv", 5, False, mkv, True, "s"),
        ("a/l.mkv", 5, True, mkv, False, "l"),
        ("TARGET/film.mkv", 5, False, mkv, False, "film"),
        ("d/bdmv/STREAM/.1", 7, False, None, True, None),
        ("d/bdmv/target/2", 8, False, None, False, None),
        ("d/VIDEO_TS/1", 9, False, None, False, None),
        (".d/BDMV/1", 9, False, None, False, None),
        ("1/2/3/f.mkv", None, False, none, False, "f"),
        (None, 1, False, mkv, False, "f"),
    ]
    frame = spark.createDataFrame(rows, "path string, size long, link boolean, head binary, sample boolean, title string").withColumn("kind", F.lit(1))
    got = [(r["path"], r["size"], r["kind"], r["container"], tuple(r["notes"])) for r in scan.scan(frame).collect()]
    assert sorted(got, key=repr) == sorted([
        ("a/film.mkv", 2_000_000, "video", "Matroska", ()), ("a/film.mkv", 2_000_000, "video", "Matroska", ()),
        ("a/film.mp4", 2_000_000, "video", "Matroska", ("extension says .mp4 but the bytes are Matroska",)),
        ("a/film", 2_000_000, "video", "Matroska", ("no title could be parsed from the name",)),
        ("a/x.srt", 0, "subtitle", None, ("zero bytes",)),
        ("d", 15, "video", "DiscStructure", ("only 0 KiB — likely truncated or a stub",)), ("d", 9, "video", "DiscStructure", ("only 0 KiB — likely truncated or a stub",)),
        ("1/2/3/f.mkv", 0, "video", None, ("no container signature matched; the player will still try it", "zero bytes")),
    ], key=repr)
    assert {r["path"] for r in scan.scan(frame, max_depth=1).collect()} == {"a/film.mkv", "a/film.mp4", "a/film", "a/x.srt", "d"}
    assert "a/s.mkv" in {r["path"] for r in scan.scan(frame, samples=True).collect()}
    assert scan.scan(frame.filter("false")).collect() == []
    assert {r["path"] for r in scan.candidates(frame).collect()} == {"a/film.mkv", "a/film.mp4", "a/x.srt", "a/s.mkv", "1/2/3/f.mkv"}
