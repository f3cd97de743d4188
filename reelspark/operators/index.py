"""A library's index over passes of a scan: verdicts, moves, tombstones, failures and what each record keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.paths import components

#: path, size, mtime, sketch, needs_review (null: none), tombstoned, and the history of checks.
RECORD = ("path", "size", "mtime", "sketch", "needs_review", "tombstoned", "verified_at", "verified_digest", "pending")
INDEX_SCHEMA = "path string, size long, mtime long, sketch string, needs_review string, tombstoned boolean, verified_at long, verified_digest string, pending boolean"
OBSERVED_SCHEMA = "path string, size long, mtime long, sketch string, needs_review string, gone boolean, unreadable boolean"


def reindex(index: DataFrame, observed: DataFrame) -> DataFrame:
    """The records of an index after a pass that observed some files, each with its verdict and the path it moved from.

    observed: path, size, mtime, sketch (null: none), needs_review (null: none), gone (the file went before it was looked at), unreadable.
    Verdicts, where ``kept`` says whether a record is in the next index:

    - unchanged: a live record with equal size and mtime; kept as it is, whatever else is observed
    - failed: unreadable; a live record is kept as it is, others are not
    - modified: a live record otherwise; kept with what is observed, its checks forgotten
    - moved: no live record, and the sketch is that of a live record that was not observed; its checks go along. The first such path in order claims
      a sketch, and takes the last of several missing records; those after it are new
    - new: all other observed files
    - vanished: gone; not kept, whether there was a record or not
    - tombstoned: a live record neither observed nor moved; kept as a tombstone
    - expired: a tombstone that a pass did not observe; not kept, so tombstones last one later pass

    Rows of an observed path after the first (by size, mtime and sketch) don't count; null paths are no files. Paths are ordered by components. Nulls of size or mtime are
    equal to each other.
    """
    rank = F.struct("size", "mtime", "sketch", "needs_review", "gone", "unreadable")
    new = observed.filter("path IS NOT NULL").groupBy("path").agg(F.min(rank).alias("n"))
    old = index.filter("path IS NOT NULL").select("path", F.struct(*RECORD).alias("o"))
    both = old.join(new, "path", "full_outer")
    live = F.col("o").isNotNull() & ~F.coalesce("o.tombstoned", F.lit(False))
    same = F.col("o.size").eqNullSafe(F.col("n.size")) & F.col("o.mtime").eqNullSafe(F.col("n.mtime"))
    verdict = (
        F.when(F.col("n").isNull(), F.when(live, "missing").otherwise("expired"))
        .when(F.col("n.gone"), "vanished").when(live & same, "unchanged").when(F.col("n.unreadable"), "failed").when(live, "modified").otherwise("fresh")
    )
    judged = both.withColumn("live", live).withColumn("verdict", verdict)
    missing, fresh = judged.filter("verdict = 'missing'"), judged.filter("verdict = 'fresh'")
    order = components(F.col("path"))
    source = missing.filter("o.sketch IS NOT NULL").groupBy(F.col("o.sketch").alias("sketch")).agg(F.max_by("o", order).alias("from_"))
    claim = fresh.filter("n.sketch IS NOT NULL").groupBy(F.col("n.sketch").alias("sketch")).agg(F.min_by("path", order).alias("path"))
    moves = claim.join(source, "sketch").select("path", "from_")

    def record(checks: str | None) -> list:
        kept = [F.col(f"{checks}.{c}").alias(c) if checks else F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("verified_at", "verified_digest")]
        pending = F.col(f"{checks}.pending") if checks else F.lit(False)
        return ["path", *(F.col(f"n.{c}").alias(c) for c in ("size", "mtime", "sketch", "needs_review")), F.lit(False).alias("tombstoned"), *kept, pending.alias("pending")]

    def as_was(rows: DataFrame, verdict: str, tombstoned: bool | None = None) -> DataFrame:
        rows = rows.select("path", *(F.col(f"o.{c}").alias(c) for c in RECORD[1:]), F.lit(verdict).alias("verdict"), "live")
        rows = rows if tombstoned is None else rows.withColumn("tombstoned", F.lit(tombstoned))
        return rows.select(*RECORD, "verdict", F.lit(None).cast("string").alias("from_path"), F.lit(verdict in ("unchanged", "tombstoned")) | (F.lit(verdict == "failed") & F.col("live")))

    arrived = fresh.join(moves, "path", "left")
    moved = arrived.filter("from_ IS NOT NULL").select(*record("from_"), F.lit("moved").alias("verdict"), F.col("from_.path").alias("from_path"), F.lit(True))
    none = arrived.filter("from_ IS NULL").select(*record(None), F.lit("new").alias("verdict"), F.lit(None).cast("string").alias("from_path"), F.lit(True))
    modified = judged.filter("verdict = 'modified'").select(*record(None), "verdict", F.lit(None).cast("string").alias("from_path"), F.lit(True))
    left = missing.join(moves.select(F.col("from_.path").alias("path")), "path", "left_anti")
    parts = [moved, none, modified, as_was(left, "tombstoned", True), *(as_was(judged.filter(F.col("verdict") == v), v) for v in ("unchanged", "failed", "vanished", "expired"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF(*RECORD, "verdict", "from_path", "kept")


def next_index(reindexed: DataFrame) -> DataFrame:
    """The index after a pass."""
    return reindexed.filter("kept").select(*RECORD)


def report(reindexed: DataFrame) -> DataFrame:
    """One row of counts. A file that needs review counts as failed and under its verdict as well; a pass changed the index if any file is new, modified, moved or tombstoned."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    suspect = F.count(F.when(F.col("verdict").isin("new", "modified", "moved") & F.col("needs_review").isNotNull(), 1))
    counts = [count(v).alias(v) for v in ("unchanged", "modified", "moved", "new", "tombstoned")]
    changed = F.count(F.when(F.col("verdict").isin("new", "modified", "moved", "tombstoned"), 1)) > 0
    return reindexed.agg(*counts, (count("failed") + suspect).alias("failed"), changed.alias("changed"))
