"""Snapshots of a library: reconciliation, integrity checks within a budget, cache eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranges import running


def reconcile(index: DataFrame, observed: DataFrame) -> DataFrame:
    """Path, verdict, from_path for observed and missing files.

    A file whose path is new and whose sketch is that of a missing one has moved; each sketch can be claimed once, by the first new
    path, and its source is the last missing path.
    """
    old, new = index.alias("o"), observed.alias("n")
    both = old.join(new, F.col("o.path") == F.col("n.path"), "full_outer").select(F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"), F.col("o.size").alias("old_size"), F.col("n.size").alias("new_size"), F.col("o.sketch").alias("old_sketch"), F.col("n.sketch").alias("new_sketch"))
    stayed = both.filter("old_path IS NOT NULL AND new_path IS NOT NULL").select(F.col("new_path").alias("path"), F.when((F.col("old_size") == F.col("new_size")) & (F.col("old_sketch") == F.col("new_sketch")), "unchanged").otherwise("modified").alias("verdict"), F.lit(None).cast("string").alias("from_path"))
    missing, fresh = both.filter("new_path IS NULL"), both.filter("old_path IS NULL")
    source = missing.groupBy(F.col("old_sketch").alias("sketch")).agg(F.max("old_path").alias("from_path"))
    claim = fresh.groupBy(F.col("new_sketch").alias("sketch")).agg(F.min("new_path").alias("path"))
    moves = claim.join(source, "sketch").select("path", "from_path")
    arrived = fresh.select(F.col("new_path").alias("path")).join(moves, "path", "left").select("path", F.when(F.col("from_path").isNotNull(), "moved").otherwise("new").alias("verdict"), "from_path")
    gone = missing.select(F.col("old_path").alias("path")).join(moves.select(F.col("from_path").alias("path")), "path", "left_anti").select("path", F.lit("tombstoned").alias("verdict"), F.lit(None).cast("string").alias("from_path"))
    return stayed.unionByName(arrived).unionByName(gone)


def verify_within(files: DataFrame, budget: int) -> DataFrame:
    """Files (path, tier, size) to read again, by tier and path, up to the budget; the very first is always read.

    Stops at the first file that does not fit. Returns path, tier, size, running.
    """
    key = F.struct("tier", "path")
    rows = running(files, ["tier", "path"], F.col("size"), "running")
    ends = rows.agg(F.min(key).alias("first"), F.min(F.when(F.col("running") > budget, key)).alias("over"))
    first_fits = rows.crossJoin(F.broadcast(ends)).filter((key == F.col("first")) | F.col("over").isNull() | (key < F.col("over")))
    return first_fits.filter((F.col("running") <= budget) | (key == F.col("first"))).select("path", "tier", "size", "running")


def evict(entries: DataFrame, now: Column, keep_days: int, capacity: int) -> DataFrame:
    """Cache entries (id, used DATE, size, readers) to drop: too old ones, then the least recently used until all fit.

    Entries with readers stay, and count. Returns id, reason.
    """
    idle = F.col("readers") == 0
    old = idle & (F.datediff(now, "used") > keep_days)
    left = entries.filter(~old)
    total = left.agg(F.sum("size").alias("total"))
    rows = running(left.filter(idle), ["used", "id"], F.col("size"), "upto").crossJoin(F.broadcast(total))
    lru = rows.filter(F.col("total") - (F.col("upto") - F.col("size")) > capacity).select("id", F.lit("capacity").alias("reason"))
    return entries.filter(old).select("id", F.lit("age").alias("reason")).unionByName(lru)


def reverify_after(base: int, size: Column) -> Column:
    """the base interval, halved at 8 GiB and again at 16 GiB."""
    return F.when(size >= 16 << 30, base >> 2).when(size >= 8 << 30, base >> 1).otherwise(base)


def verify_pass(index: DataFrame, digests: DataFrame, now: int, every: int, budget: int) -> DataFrame:
    """What one pass of integrity checks finds in each file that is due: path, tier, outcome.

    index: path, size, tombstoned, pending (an unresolved mismatch), verified_at, verified_digest, needs_review; digests: path, digest (null: the read
    failed). Tiers: 0 pending, 1 never verified, 2 flagged when probed, 3 routine; the last two are due when their interval has passed. Files are
    read by tier, last check and path until one does not fit in the budget with what was read before; failed reads cost nothing, and the very first file is
    always read. Outcomes: baseline, confirmed, mismatched, read_failed, skipped.
    """
    due = (F.lit(now) - F.col("verified_at")) >= reverify_after(every, F.col("size"))
    tier = F.when(F.col("pending"), 0).when(F.col("verified_at").isNull(), 1).when(due, F.when(F.col("needs_review").isNotNull(), 2).otherwise(3))
    rows = index.filter(~F.col("tombstoned")).withColumn("tier", tier).filter("tier IS NOT NULL").join(digests, "path", "left")
    cost = F.when(F.col("digest").isNotNull(), F.col("size")).otherwise(0).cast("long")
    rows = running(rows.select("tier", "verified_at", "path", "size", "verified_digest", "digest"), ["tier", "verified_at", "path"], cost, "upto")
    key = F.struct("tier", "verified_at", "path")
    need = F.col("upto") - cost + F.col("size")
    first = rows.agg(F.min(key).alias("first"))
    rows = rows.crossJoin(F.broadcast(first))
    over = rows.filter((key != F.col("first")) & (need > budget)).agg(F.min(key).alias("over"))
    read = F.when(F.col("digest").isNull(), "read_failed").when(F.col("verified_digest").isNull(), "baseline").when(F.col("verified_digest") == F.col("digest"), "confirmed").otherwise("mismatched")
    rows = rows.crossJoin(F.broadcast(over))
    return rows.select("path", "tier", F.when(F.col("over").isNull() | (key < F.col("over")), read).otherwise("skipped").alias("outcome"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, changed: whether two snapshots with the same columns differ, counting repeated rows. Both are reduced to sums of row hashes in one pass."""
    key = F.xxhash64(*before.columns).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *before.columns).cast("decimal(38,0)")
    sides = before.withColumn("side_", F.lit(1)).unionByName(after.withColumn("side_", F.lit(-1)))
    sums = sides.agg(*(F.coalesce(F.sum(k * F.col("side_")), F.lit(0)).alias(n) for k, n in zip(key, ("a", "b"), strict=True)), F.coalesce(F.sum("side_"), F.lit(0)).alias("n"))
    return sums.select(((F.col("a") != 0) | (F.col("b") != 0) | (F.col("n") != 0)).alias("changed"))
