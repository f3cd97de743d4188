"""Grouping, duplicates, totals, search and browsing of a media library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import ascii_lower, human_size
from reelspark.operators.ranges import numbered


def logical_items(files: DataFrame) -> DataFrame:
    """A1, O3: files of one title and kind are one item; the display title is that of the first path."""
    return files.groupBy(ascii_lower(F.col("title")).alias("item"), "kind").agg(F.min_by("title", "path").alias("title"), F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """A2, A3: files with equal sketches; all but the first of a group can be recovered. Counts only, so hot groups combine before the shuffle."""
    groups = files.groupBy("sketch").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("size").alias("size"))
    return groups.filter("n_files > 1").select("sketch", "n_files", "first_path", ((F.col("n_files") - 1) * F.col("size")).alias("recoverable"))


def totals(files: DataFrame) -> DataFrame:
    """Files, items and bytes for each kind, a null kind as 'unidentified'."""
    out = files.groupBy(F.coalesce("kind", F.lit("unidentified")).alias("kind")).agg(F.count("*").alias("n_files"), F.countDistinct(ascii_lower(F.col("title"))).alias("n_items"), F.sum("size").alias("bytes"))
    return out.withColumn("label", human_size(F.col("bytes")))


def search(files: DataFrame, wanted: str) -> DataFrame:
    """P5: ASCII-case-insensitive substring of title or path; an empty query finds all."""
    if not wanted:
        return files
    wanted = "".join(c.lower() if c.isascii() else c for c in wanted)
    hit = F.lit(False)
    for c in ("title", "path"):
        hit = hit | F.coalesce(ascii_lower(F.col(c)).contains(wanted), F.lit(False))
    return files.filter(hit)


def name_order(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """O1: number all files by path for paging, component by component, range by range. Equal paths must not repeat."""
    placed = files.withColumn("parts_", F.replace("path", F.lit("/"), F.lit("\u0000")))  # below every other character, so components decide
    return numbered(placed, ["parts_"], "position", ranges).drop("parts_")


def page(files: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` files (0: all) after the first ``start`` by path, each with its position and the number of all files."""
    rows = name_order(files).filter(F.col("position") > start)
    if count:
        rows = rows.filter(F.col("position") <= start + count)
    return rows.crossJoin(F.broadcast(files.agg(F.count("*").alias("total"))))


def tree_totals(leaves: DataFrame, levels: list[str], size: str) -> DataFrame:
    """For every node of a hierarchy the leaves below it and their size; one pass by rollup."""
    out = leaves.rollup(*levels).agg(F.count("*").alias("n_leaves"), F.round(F.sum(size), 2).alias("size"), F.grouping_id().alias("g"))
    path = F.concat_ws("/", F.lit("root"), *levels)
    depth = F.lit(len(levels)) - F.bit_count("g")
    return out.select(path.alias("node"), depth.cast("int").alias("depth"), "n_leaves", "size")
