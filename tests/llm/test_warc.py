"""Archives: round trips, payloads that hold records, splits anywhere, broken files."""

import glob
import hashlib
import random
from collections import Counter

import pytest

from reelspark.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "x") for i, u, h in rows], "page_id long, url string, html string, offset long, digest string")


def odd_pages(n=40):
    r = random.Random(4)
    long = "<p>long enough to be referred to</p>" * 5
    out = [(0, None, None), (1, "http://a/\r\nX: y", ""), (2, "u", "short"), (3, "u", "short"), (9, "u", long), (5, "u", long), (7, "u", long), (7, "u", long), (None, "u", long), (None, "v", "lonely" * 40)]
    for i in range(10, 10 + n):
        body = "".join(r.choice(["<b>é</b>", "\r\n\r\n", "WARC/1.1\r\n", "WARWARC/1.1\r\n", "WARC/1.", FAKE.format(r.randint(0, 300)), FAKE.format(2) + "ab\r\n\r\n", "text 日本 "]) for _ in range(r.randint(0, 12)))
        out.append((i, f"http://h/{i}", body if i % 3 else "plain " * i))
    out += [(100, "u", FAKE.format(5)), (101, "u", (FAKE.format(2) + "ab\r\n\r\n") * 50), (102, "u", "x" * 100_000), (103, "u", "\r\n\r\n" + "WARC/1.1\r\n" * 30)]
    return out


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    return Counter((i, len(p), hashlib.sha256(p).hexdigest(), "response" if first.get(p, i) == i else "revisit", None if first.get(p, i) == i else first[p]) for i, p in payloads)


@pytest.mark.parametrize("split", [None, "5000"])
def test_digests(spark, split):
    rows = odd_pages()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        frame = warc.archive_digests(pages(spark, rows).repartition(3))
        assert Counter(tuple(x) for x in frame.collect()) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archive_is_readable_by_rule_and_payloads_come_back(spark, tmp_path):
    rows = [x for x in odd_pages() if x[0] is not None]
    path = f"{tmp_path}/archive"
    warc.write_archive(pages(spark, rows).coalesce(2), path)
    found = 0
    for name in glob.glob(f"{path}/part-*"):
        data, at = open(name, "rb").read(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            head = data.index(b"\r\n\r\n", at)
            fields = dict(x.split(b": ", 1) for x in data[at:head].split(b"\r\n")[1:])
            at = head + 4 + int(fields[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n" and b"X" not in fields
            at, found = at + 4, found + 1
    assert found == len(rows)
    got = warc.read_archive(spark, path, payload=True).collect()
    assert all(x["complete"] for x in got) and all(x["declared_digest"] == x["payload_digest"] for x in got)
    kept = Counter((int(x["record_id"]), bytes(x["payload"])) for x in got if x["record_type"] == "response")
    revisits = {x[0] for x in expected(rows) if x[3] == "revisit"}
    assert kept == Counter((i, (h or "").encode()) for i, _, h in rows if i not in revisits)


def test_records_after_a_break_are_not_reached(spark, tmp_path):
    whole = "".join(FAKE.format(len(b)).replace("666", str(i)) + b + "\r\n\r\n" for i, b in enumerate(["a\r\n\r\nb", "c" * 30, "d"]))
    cut = whole.replace("Content-Length: 30", "Content-Length: 31")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.warc").write_bytes(whole.encode())
    (tmp_path / "in" / "cut.warc").write_bytes(cut.encode())
    got = sorted((x["file"], x["record_id"], x["complete"]) for x in warc.read_archive(spark, f"{tmp_path}/in").collect())
    assert got == [("cut.warc", "0", True), ("cut.warc", "1", False), ("good.warc", "0", True), ("good.warc", "1", True), ("good.warc", "2", True)]


def test_no_pages(spark):
    assert warc.archive_digests(pages(spark, [])).collect() == []
