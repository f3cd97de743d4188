"""What a file is: sampled sketches, whole digests, and duplicates that are verified by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of each of the three samples.
CHUNK = 1 << 20


def read_cost(size: Column, chunk: int = CHUNK) -> Column:
    """bytes that a sketch reads."""
    return F.least(size, F.lit(3 * chunk))


def little_endian(number: Column) -> Column:
    """Eight bytes of a whole number that is not negative, the lowest first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8))))


def sketch(content: Column, chunk: int = CHUNK) -> Column:
    """SHA-256 in hex of a file's size and of its first, middle and last ``chunk`` bytes, or of all its bytes if there are at most three times so many. Null for null."""
    size = F.octet_length(content)
    cut = lambda start: F.substring(content, start + 1, F.lit(chunk))
    middle = (F.floor(size / 2) - chunk // 2).cast("int")
    sampled = F.when(size <= 3 * chunk, content).otherwise(F.concat(cut(F.lit(0)), cut(middle), cut(size - chunk)))
    return F.sha2(F.concat(little_endian(size), sampled), 256)


def digest(content: Column) -> Column:
    """SHA-256 in hex of all bytes."""
    return F.sha2(content, 256)


def verified_duplicates(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Groups of files (path, content: binary) with equal sketches, and whether their bytes are equal to those of the first.

    Returns sketch, n_files, first_path, n_contents, verified (one content only), n_same (files like the first, itself included) and recoverable (bytes of all but one file
    of each content). Files of equal content are counted before anything is grouped by sketch, so a hot group leaves a row a task. Files without content are in no group; rows with equal paths are
    files each.
    """
    known = files.filter("content IS NOT NULL").select("path", sketch(F.col("content"), chunk).alias("sketch"), digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("size"))
    contents = known.groupBy("sketch", "digest").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max("size").alias("size"))
    groups = contents.groupBy("sketch").agg(
        F.sum("n").alias("n_files"),
        F.min("path").alias("first_path"),
        F.count("*").alias("n_contents"),
        F.min_by("n", F.struct("path", "digest")).alias("n_same"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("recoverable"),
    )
    return groups.filter("n_files > 1").select("sketch", "n_files", "first_path", "n_contents", (F.col("n_contents") == 1).alias("verified"), "n_same", "recoverable")
