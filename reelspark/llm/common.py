"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else is part of a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; all other letters stay."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and all runs on this machine (tests)."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="reelspark-")
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, label: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Bits of a key filter; its table has at most a 64th as many rows of two numbers, whatever the number of keys.
FILTER_BITS = 1 << 24


def mark_known(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add ``known`` (boolean) to rows: false only where the key is none of those in keys.

    One bit for each hash value modulo FILTER_BITS, so what is broadcast has a fixed bound; with many more keys than bits all
    rows are marked. It spares rows a shuffle and never decides a result.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    marked = rows.withColumn("word_", word).withColumn("bit_", bit).join(F.broadcast(words), "word_", "left")
    return marked.withColumn("known", F.coalesce(F.col("bits_").bitwiseAND(F.col("bit_")) != 0, F.lit(False))).drop("word_", "bit_", "bits_")
