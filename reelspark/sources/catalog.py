"""Library-shaped views of the driver's tables: every query of the catalog starts from one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows a task gets of work that costs much more than reading them.
ROWS_A_TASK = 250_000


def spread(rows: DataFrame, a_task: int = ROWS_A_TASK, *by: str) -> DataFrame:
    """The rows dealt over tasks of about ``a_task`` each (by columns, else evenly), however few files or row groups they come from and however many there are."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // a_task + 1)
    return rows.repartition(n, *by)


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, title, kind, size, sketch: one media file for each document; equal texts have equal sketches."""
    return as_files(table(spark, sf_dir, "documents"))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents, a table or a stream, as files."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id")))
    return documents.select("doc_id", path.alias("path"), F.col("source").alias("title"), F.col("lang").alias("kind"), F.col("n_chars").alias("size"), F.md5("text").alias("sketch"), "text")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index of yesterday and what a scan observes today: some files new, changed, moved or gone."""
    all_ = files(spark, sf_dir).select("doc_id", "path", "size", "sketch")
    index = all_.filter("doc_id % 7 != 0").select("path", "size", "sketch")
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    observed = all_.filter("doc_id % 13 != 0").select(moved.alias("path"), (F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"), "sketch")
    return index, observed


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, at, start_ms, end_ms, text: subtitle cues, some out of order, some overlapping."""
    start = F.col("turn") * 4000 - F.when(F.col("turn") % 5 == 4, 6000).otherwise(0)
    end = start + F.lit(1500) + (F.length("text") % 60) * 60
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("at"), start.alias("start_ms"), end.alias("end_ms"), "text")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, provider, field, value: metadata found by several providers; some values are blank."""
    value = F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("v"), F.col("o_orderkey") % 97))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("field"), value.alias("value"))


def artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, kind, provider_rank, rating (may be null), votes, width, url."""
    rating = F.when(F.col("l_quantity") % 10 != 0, F.round(F.col("l_discount") * 100, 0))
    url = F.concat_ws("-", F.lit("art"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3).alias("provider_rank"), rating.alias("rating"), F.col("l_quantity").cast("long").alias("votes"), (F.col("l_suppkey") % 5 * 400 + 400).alias("width"), url.alias("url"))
