"""WARC archives: written by Spark's text writer, read back record by record with the chain of records verified.

Every place with the magic line is a candidate record; its header names a successor. Whether a candidate is a record or stands inside a
payload is decided by the chain alone: pointers from candidate to successor are doubled, starting at each file's first byte, and only
what is reached is a record. The reader splits files anywhere at the magic, so a large archive is read by many tasks; offsets are
prefix sums over the splits of a file, and the sums must give the file's size. A record whose payload holds the magic comes in several
pieces; the pieces are found by pointers to the candidate before, doubled likewise, and fetched by their digests in a second read, so that only they are shuffled.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is written whole, and the others as revisits without
payload. Defined results: a null html is an empty payload; a null url has no target; rows equal in page_id and payload are written alike, each as a record;
pages without a page_id never are the smallest unless all of the payload's are; other columns are not read; an empty table gives an archive without records.
Records after a broken one are not reached, and the broken one has ``complete`` false.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import discard, mark_known, materialise, remove, scratch_path

#: Fixed values of the format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID, _DIGEST = "urn:page:", "sha256:"

#: Records in a file at most; files of any size are read alike.
RECORDS = 20_000

_FIELDS = "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string"


def _header(pairs: list[tuple[str, Column]]) -> Column:
    """Lines of a header; those whose value is null are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs))


def write_archive(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """pages: page_id, url, html. Writes WARC files into a folder, a record a page."""
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    base = base.withColumn("n_bytes", F.octet_length("html"))
    copies = base.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("times")).filter("times > 1").drop("times")
    copies = materialise(copies, "copies")
    marked = mark_known(base, copies, "digest")
    alone = marked.filter("NOT known").withColumn("first_id", F.lit(None).cast(copies.schema["first_id"].dataType))
    shared = marked.filter("known").join(copies, "digest", "left")
    rows = alone.unionByName(shared)
    again = (F.col("n_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    rows = rows.withColumn("again", again).withColumn("block", F.concat(http, F.when(~F.col("again"), F.col("html")).otherwise("")))
    kind = F.when(F.col("again"), "revisit").otherwise("response")
    header = _header([
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Payload-Digest", F.concat(F.lit(_DIGEST), F.lower(F.hex("digest")))),
        ("WARC-Profile", F.when(F.col("again"), F.lit(REVISIT))),
        ("WARC-Refers-To", F.when(F.col("again"), name(F.col("first_id")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ])
    record = F.concat(F.lit(MAGIC), header, F.lit("\r\n"), F.col("block"))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)
    discard(copies)


def _named(value: bytes | None) -> str | None:
    """The id between the brackets of a record's name."""
    text = value.decode("utf-8", "replace").strip("<> ") if value else ""
    return text.removeprefix(_ID) if text.startswith(_ID) else text or None


def _parse(row: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields, where the block begins and its length; None if there is no whole header with a length."""
    cut = row.find(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, _, v in (line.partition(b": ") for line in row[:cut].split(b"\r\n"))) if cut >= 0 else {}
    length = fields.get(b"content-length", b"")
    return (fields, cut + 4, int(length)) if length.isdigit() and len(length) < 16 else None


def _describe(fields: dict[bytes, bytes], block: bytes) -> tuple[list, bytes]:
    """The values of _FIELDS, and the payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    declared = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix(_DIGEST)
    uri, size, digest = fields.get(b"warc-target-uri"), len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":  # its payload is the other record's
        said = [x.partition(b": ")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length: ")]
        size, digest = (int(said[0]) if said and said[0].isdigit() else None), declared
    return [_named(fields.get(b"warc-record-id")), kind, uri.decode("utf-8", "replace") if uri is not None else None, _named(fields.get(b"warc-refers-to")), declared, size, digest], payload


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the magic lines of all files, and before the first."""
    rows = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return rows.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("_metadata.file_size").alias("file_size"))


def _candidates(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """A row a piece: its split, place in the split, length and, of a whole record, what the record says."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, before = None, 0, None
        for batch in batches:
            out = []
            for piece, file, start, file_size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != (file, start):
                    split, at, before = (file, start), 0, None
                found, ahead, values, body = _parse(piece), None, [None] * 7, None
                if found:
                    fields, begin, length = found
                    ahead = begin + length + len(END)
                    if ahead == len(piece) and piece.endswith(b"\r\n\r\n"):
                        values, body = _describe(fields, piece[begin : begin + length])
                out.append((file, start, file_size, at, len(piece), before, hashlib.sha256(piece).digest(), ahead, *values, body if payload else None))
                at, before = at + len(piece) + len(MAGIC), len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], names)

    schema = f"file string, block_start long, file_size long, at long, length long, before long, digest binary, ahead long, {_FIELDS}, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return _pieces(spark, path).mapInArrow(scan, schema)


def _with_offsets(scanned: DataFrame) -> DataFrame:
    """Add offset of the magic before each piece (negative for what precedes the first), successor and previous."""
    sep = len(MAGIC)
    splits = scanned.groupBy("file", "block_start", "file_size").agg(F.sum(F.col("length") + sep).alias("bytes"), F.max_by("length", "at").alias("last"))
    along = Window.partitionBy("file").orderBy("block_start")
    splits = splits.withColumn("base", F.sum("bytes").over(along) - F.col("bytes")).withColumn("last", F.lag("last").over(along))
    # the last piece has no magic after it, unless the file ends with one
    left = F.max("base_end").over(Window.partitionBy("file")) - F.col("file_size")
    splits = splits.withColumn("base_end", F.col("base") + F.col("bytes"))
    splits = splits.withColumn("base", F.when(left.isin(0, sep), F.col("base")).otherwise(F.raise_error(F.concat(F.lit("pieces do not add up to the size of "), F.col("file")))))
    placed = scanned.join(splits.select("file", "block_start", "base", F.col("last").alias("last_")), ["file", "block_start"])
    offset = F.col("base") + F.col("at") - sep
    placed = placed.withColumn("offset", offset).withColumn("successor", F.col("offset") + sep + F.col("ahead"))
    return placed.withColumn("previous", F.col("offset") - F.coalesce("before", "last_") - sep).drop("base", "last_", "before", "at", "block_start", "ahead")


def reachable(links: DataFrame) -> DataFrame:
    """links: file, offset, successor. Returns file and offset of what is reached from offset 0 of each file.

    Pointers are doubled each round, so a chain of n records takes about log2(n) rounds of joins by (file, offset).
    """
    edges = links.filter("successor IS NOT NULL").select("file", "offset", F.col("successor").alias("jump"))
    known = links.select("file", F.col("offset").alias("jump"))
    jumps = materialise(edges.join(known, ["file", "jump"], "left_semi").select("file", "offset", "jump"), "jumps")
    reached = materialise(links.filter("offset = 0").select("file", "offset").distinct(), "reached")
    count = reached.count()
    while True:
        fresh = reached.join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        more = materialise(reached.union(fresh).distinct(), "reached")
        further = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        twice = materialise(jumps.join(further, ["file", "jump"]).select("file", "offset", F.col("far").alias("jump")), "jumps")
        discard(reached, jumps)
        reached, jumps = more, twice
        now = reached.count()
        if now == count:
            discard(jumps)
            return reached
        count = now


def _owners(inside: DataFrame) -> DataFrame:
    """inside: file, offset, previous of all candidates that are no records. Adds owner, the nearest record before, by doubling."""
    to = materialise(inside.select("file", "offset", F.col("previous").alias("owner")), "owners")
    while True:
        further = to.select("file", F.col("offset").alias("owner"), F.col("owner").alias("far"))
        joined = to.join(further, ["file", "owner"], "left")
        twice = materialise(joined.select("file", "offset", F.coalesce("far", "owner").alias("owner"), F.col("far").isNotNull().alias("open")), "owners")
        discard(to)
        to = twice
        if not to.filter("open").head(1):
            return to


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """All records of the WARC files of a folder: file, offset, record_id, record_type, target_uri, refers_to, declared_digest, payload_bytes,
    payload_digest (of the bytes read; a revisit's as declared), complete (a record or the file's end follows) and, if asked for, payload."""
    scanned = materialise(_candidates(spark, path, payload), "scanned")
    placed = materialise(_with_offsets(scanned).filter("offset >= 0"), "candidates")
    discard(scanned)
    reached = reachable(placed)
    key = ["file", "offset"]
    known = placed.select("file", F.col("offset").alias("successor")).withColumn("follows", F.lit(True))
    records = placed.join(reached, key, "left_semi").join(known, ["file", "successor"], "left")
    records = records.withColumn("complete", F.coalesce("follows", F.col("successor") == F.col("file_size"), F.lit(False)))
    columns = [*key, *(x.split()[0] for x in _FIELDS.split(", ")), "complete", "payload"]
    whole = records.filter("record_type IS NOT NULL").select(*columns)
    parted = materialise(records.filter("record_type IS NULL").select(*key, "digest", "complete"), "parted")
    if not parted.head(1):
        out = materialise(whole, "records")
    else:
        owners = _owners(placed.join(reached, key, "left_anti"))
        inner = owners.select("file", "offset", F.col("owner").alias("first")).join(placed.select(*key, "digest"), key)
        heads = parted.select("file", F.col("offset").alias("first"), "complete")
        asked = inner.join(heads, ["file", "first"]).unionByName(parted.select("file", "offset", F.col("offset").alias("first"), "digest", "complete"))
        asked = materialise(asked, "asked")
        pieces = mark_known(_pieces(spark, path).select("piece", F.unhex(F.sha2("piece", 256)).alias("digest")), asked.select("digest").distinct(), "digest")
        content = pieces.filter("known").groupBy("digest").agg(F.first("piece").alias("piece"))
        joined = asked.join(content, "digest").groupBy("file", "first", "complete").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))

        def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, first, complete, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    record = MAGIC.encode().join(p["piece"] for p in parts)
                    found = _parse(record)
                    fields, begin, length = found or ({}, len(record), 0)
                    values, body = _describe(fields, record[begin : begin + length])
                    ends = bool(found) and complete and record[begin + length :] == b"\r\n\r\n"
                    row = (file, first, *values, ends, body if payload else None)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], columns)

        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        stitched = joined.select("file", "first", "complete", "parts").mapInArrow(stitch, f"file string, offset long, {_FIELDS}, complete boolean, payload binary")
        out = materialise(whole.unionByName(stitched), "records")
        discard(owners, asked)
    discard(placed, reached, parted)
    return out if payload else out.drop("payload")


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write a record a page, read the archive back, and return each record's payload size, digest, type and the page it refers to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    records = read_archive(spark, path)
    remove(spark, path)
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.nullif("record_id", F.lit("")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
