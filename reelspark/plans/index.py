"""Queries on passes of a scan and on content, made from the documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import identity
from reelspark.operators import index as ix
from reelspark.plans.live import scratch
from reelspark.sources import catalog
from reelspark.sources.catalog import table
from reelspark.streaming.index import LibraryIndex

#: Bytes of a sample in the query on duplicates: documents are shorter than files.
_CHUNK = 256


def _index(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    rows = docs.filter(i % 7 != 0)
    return rows.select(
        "path", "size", (i * 10).alias("mtime"), "sketch", F.lit(None).cast("string").alias("needs_review"), (i % 17 == 0).alias("tombstoned"),
        F.when(i % 3 == 0, i).alias("verified_at"), F.when(i % 3 == 0, F.col("sketch")).alias("verified_digest"), (i % 41 == 0).alias("pending"),
    )


def _observed(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    rows = docs.filter(i % 13 != 0)
    path = F.when(i % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    return rows.select(
        path.alias("path"), (F.col("size") + (i % 5 == 0).cast("long")).alias("size"), (i * 10 + (i % 6 == 0).cast("long")).alias("mtime"), F.when(i % 31 != 0, F.col("sketch")).alias("sketch"),
        F.when(i % 29 == 0, "suspect").alias("needs_review"), (i % 19 == 0).alias("gone"), (i % 23 == 0).alias("unreadable"),
    )


def index_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record after a pass, with its verdict."""
    docs = catalog.files(spark, sf_dir).drop("text")
    return ix.reindex(_index(docs), _observed(docs))


def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a pass, files that need review twice."""
    return ix.report(index_pass(spark, sf_dir))


def live_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index kept up by micro-batches of a stream of the documents, some files a batch, with the version of each record's pass."""
    docs = catalog.files(spark, sf_dir).drop("text")
    folder = scratch(spark, "index")
    live = LibraryIndex(spark, folder)
    live.begin(_index(docs))
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.{{parquet}}")
    rows = _observed(catalog.as_files(stream).drop("text")).withColumn("pass", F.lit(1).cast("long"))
    rows.writeStream.foreachBatch(live.observe).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    live.close(1)
    return live.index().crossJoin(F.broadcast(live.log().filter("pass = 1").select("version")))


def verified_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by sketch, verified; some documents have an equal copy, some one that differs only where no sample is."""
    rows = catalog.files(spark, sf_dir).select("doc_id", "path", F.col("text").cast("binary").alias("content"))
    twins = rows.filter("doc_id % 50 = 1").select(F.concat("path", F.lit(".copy")).alias("path"), "content")
    other = rows.filter((F.col("doc_id") % 50 == 0) & (F.octet_length("content") > 3 * _CHUNK + 64))
    near = other.select(F.concat("path", F.lit(".near")).alias("path"), F.overlay("content", F.unhex(F.lit("23")), _CHUNK + 9, 1).alias("content"))
    return identity.verified_duplicates(rows.select("path", "content").unionByName(twins).unionByName(near), _CHUNK)


QUERIES = {f.__name__: f for f in (index_pass, index_report, live_index, verified_duplicates)}

_PASS = """files AS (
  SELECT doc_id AS i, source || '/' || lang || '/doc_' || doc_id AS path, n_chars AS size, md5(text) AS sketch, text FROM documents
), old AS (
  SELECT path, size, i * 10 AS mtime, sketch, NULL::VARCHAR AS needs_review, i % 17 = 0 AS tombstoned, CASE WHEN i % 3 = 0 THEN i END AS verified_at, CASE WHEN i % 3 = 0 THEN sketch END AS verified_digest, i % 41 = 0 AS pending
  FROM files WHERE i % 7 <> 0
), new AS (
  SELECT CASE WHEN i % 11 = 0 THEN 'moved/' || path ELSE path END AS path, size + (i % 5 = 0)::BIGINT AS size, i * 10 + (i % 6 = 0)::BIGINT AS mtime, CASE WHEN i % 31 <> 0 THEN sketch END AS sketch,
    CASE WHEN i % 29 = 0 THEN 'suspect' END AS needs_review, i % 19 = 0 AS gone, i % 23 = 0 AS unreadable FROM files WHERE i % 13 <> 0
), judged AS (
  SELECT n.*, o.path IS NOT NULL AND NOT o.tombstoned AS live, CASE WHEN gone THEN 'vanished' WHEN NOT coalesce(o.tombstoned, true) AND o.size = n.size AND o.mtime = n.mtime THEN 'unchanged'
    WHEN unreadable THEN 'failed' WHEN NOT coalesce(o.tombstoned, true) THEN 'modified' ELSE 'fresh' END AS verdict FROM new n LEFT JOIN old o ON o.path = n.path
), missing AS (
  SELECT *, row_number() OVER (PARTITION BY sketch ORDER BY string_split(path, '/') DESC) AS place FROM old WHERE NOT tombstoned AND path NOT IN (SELECT path FROM new)
), claims AS (
  SELECT *, row_number() OVER (PARTITION BY sketch ORDER BY string_split(path, '/')) AS place FROM judged WHERE verdict = 'fresh'
), moves AS (
  SELECT c.path, m.path AS from_path, m.verified_at, m.verified_digest, m.pending FROM claims c JOIN missing m ON c.sketch = m.sketch WHERE c.place = 1 AND m.place = 1
), pass AS (
  SELECT j.path, j.size, j.mtime, j.sketch, j.needs_review, false AS tombstoned, m.verified_at, m.verified_digest, coalesce(m.pending, false) AS pending,
    CASE WHEN m.path IS NOT NULL THEN 'moved' WHEN verdict = 'fresh' THEN 'new' ELSE verdict END AS verdict, from_path, true AS kept
  FROM judged j LEFT JOIN moves m ON m.path = j.path WHERE verdict IN ('fresh', 'modified')
  UNION ALL SELECT j.path, o.size, o.mtime, o.sketch, o.needs_review, o.tombstoned, o.verified_at, o.verified_digest, o.pending, verdict, NULL, verdict = 'unchanged' OR verdict = 'failed' AND live
  FROM judged j LEFT JOIN old o ON o.path = j.path WHERE verdict IN ('unchanged', 'failed', 'vanished')
  UNION ALL SELECT path, size, mtime, sketch, needs_review, true, verified_at, verified_digest, pending, 'tombstoned', NULL, true FROM missing WHERE path NOT IN (SELECT from_path FROM moves)
  UNION ALL SELECT path, size, mtime, sketch, needs_review, tombstoned, verified_at, verified_digest, pending, 'expired', NULL, false FROM old WHERE tombstoned AND path NOT IN (SELECT path FROM new)
)"""

ORACLES = {
    "index_pass": f"WITH {_PASS} SELECT * FROM pass",
    "index_report": f"""WITH {_PASS} SELECT count(*) FILTER (verdict = 'unchanged') AS unchanged, count(*) FILTER (verdict = 'modified') AS modified, count(*) FILTER (verdict = 'moved') AS moved,
  count(*) FILTER (verdict = 'new') AS new, count(*) FILTER (verdict = 'tombstoned') AS tombstoned,
  count(*) FILTER (verdict = 'failed' OR verdict IN ('new', 'modified', 'moved') AND needs_review IS NOT NULL) AS failed, count(*) FILTER (verdict IN ('new', 'modified', 'moved', 'tombstoned')) > 0 AS changed FROM pass""",
    "live_index": f"""WITH {_PASS} SELECT path, size, mtime, sketch, needs_review, tombstoned, verified_at, verified_digest, pending,
  (SELECT (count(*) FILTER (verdict IN ('new', 'modified', 'moved', 'tombstoned')) > 0)::BIGINT FROM pass) AS version FROM pass WHERE kept""",
    # bytes as hex digits, two a byte
    "verified_duplicates": f"""WITH texts AS (
  SELECT doc_id, source || '/' || lang || '/doc_' || doc_id AS path, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL
), files AS (
  SELECT path, h FROM texts UNION ALL SELECT path || '.copy', h FROM texts WHERE doc_id % 50 = 1
  UNION ALL SELECT path || '.near', h[1:{2 * _CHUNK + 16}] || '23' || h[{2 * _CHUNK + 19}:] FROM texts WHERE doc_id % 50 = 0 AND len(h) // 2 > {3 * _CHUNK + 64}
), sized AS (
  SELECT *, len(h) // 2 AS size, lpad(to_hex(len(h) // 2), 16, '0') AS b FROM files
), known AS (
  SELECT path, size, sha256(unhex(h)) AS digest, sha256(unhex(b[15:16] || b[13:14] || b[11:12] || b[9:10] || b[7:8] || b[5:6] || b[3:4] || b[1:2] || CASE WHEN size <= {3 * _CHUNK} THEN h
    ELSE h[1:{2 * _CHUNK}] || h[2 * (size // 2 - {_CHUNK // 2}) + 1:2 * (size // 2 + {_CHUNK // 2})] || h[2 * (size - {_CHUNK}) + 1:] END)) AS sketch FROM sized
), contents AS (
  SELECT sketch, digest, count(*) AS n, min(path) AS path, max(size) AS size FROM known GROUP BY sketch, digest
)
SELECT sketch, sum(n)::BIGINT AS n_files, min(path) AS first_path, count(*) AS n_contents, count(*) = 1 AS verified, arg_min(n, path) AS n_same, sum((n - 1) * size)::BIGINT AS recoverable
FROM contents GROUP BY sketch HAVING sum(n) > 1""",
}
