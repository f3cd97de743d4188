"""Numbering, running sums and carried values along an order, range by range: no global window, no window by key, and no range that a hot value
fills unless its rows are equal in all. What a range needs of those before it is one row a range."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a sample for each range; ranges * SAMPLE rows are all that the driver holds.
SAMPLE = 32


def written(rows: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all runs on this machine."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="reelspark-"))
    return rows.checkpoint()


def _count(rows: DataFrame, ranges: int | None) -> int:
    return ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_range(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """Add range_ (int): rows dealt by their place along the order (columns, ascending, nulls first), in about equal parts."""
    n = _count(rows, ranges)
    key = F.struct(*order)
    found = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * n).collect() if n > 1 else []
    # ranked with Python's order of the same kind: nulls first, texts by their bytes
    def place(r) -> list:
        return [(x is not None, x.encode() if isinstance(x, str) else x) if x is not None else (False, b"") for x in r["k"]]

    found.sort(key=place)
    step = max(1, len(found) // n)
    borders = [r["k"] for r in found[step::step]]
    if not borders:
        return rows.withColumn("range_", F.pmod(F.hash(*order), F.lit(1)))  # 0; a literal would leave windows by range without a partition
    fields = rows.select(key.alias("k")).schema["k"].dataType.fields
    literal = [F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(b, fields, strict=True))) for b in borders]
    # chunks of borders, so that a row is compared with about 2 * sqrt(n) of them
    width = math.isqrt(len(literal) - 1) + 1
    chunks = [F.array(*literal[i : i + width]) for i in range(0, len(literal), width)]
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    chunk = below(F.array(*literal[::width]))
    inside = below(F.get(F.array(*chunks), F.col("chunk_") - 1))
    placed = rows.withColumn("chunk_", chunk)
    return placed.withColumn("range_", F.when(F.col("chunk_") == 0, 0).otherwise((F.col("chunk_") - 1) * width + inside)).drop("chunk_")


def running(rows: DataFrame, order: list[str], amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Add the sum of amount (no nulls) over all rows up to this one along the order, which must tell rows apart."""
    placed = with_range(rows, order, ranges).withColumn("amount_", amount)
    sums = placed.groupBy("range_").agg(F.sum("amount_").alias("sum_"))  # one row a range
    before = sums.withColumn("before_", F.sum("sum_").over(Window.orderBy("range_")) - F.col("sum_")).drop("sum_")
    inside = F.sum("amount_").over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "range_").withColumn(name, inside + F.col("before_")).drop("amount_", "before_", "range_")


def numbered(rows: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Add the place along the order, from 1."""
    return running(rows, order, F.lit(1).cast("long"), name, ranges)


def carried(rows: DataFrame, order: list[str], value: Column, name: str, ranges: int | None = None, before: bool = False) -> DataFrame:
    """Add the last value that is not null up to this row (or only before it) along the order, which must tell rows apart."""
    n = _count(rows, ranges)
    # dealt once: the rows and what the ranges hand on come from the same exchange
    placed = with_range(rows, order, n).withColumn("value_", value).repartition("range_")
    last = placed.filter("value_ IS NOT NULL").groupBy("range_").agg(F.max_by("value_", F.struct(*order)).alias("last_"))
    every = rows.sparkSession.range(2 * n + 2).select(F.col("id").cast("int").alias("range_")).join(last, "range_", "left")
    handed = every.select("range_", F.last("last_", True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)).alias("handed_"))
    inside = F.last("value_", True).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    joined = placed.join(F.broadcast(handed), "range_")
    return joined.withColumn(name, F.coalesce(inside, F.col("handed_"))).drop("value_", "handed_", "range_")


def lagged(rows: DataFrame, key: str, order: list[str], columns: list[str], ranges: int | None = None) -> DataFrame:
    """Add before_<column> for each column: its value in the row before with the same key; null for a key's first row. A key may span ranges."""
    held = F.struct(F.col(key).alias("key_"), *columns)
    found = carried(rows, [key, *order], held, "row_", ranges, before=True)
    same = F.col("row_.key_").eqNullSafe(F.col(key)) & F.col("row_").isNotNull()
    return found.select(*rows.columns, *(F.when(same, F.col(f"row_.{c}")).alias(f"before_{c}") for c in columns))


def at_share(rows: DataFrame, key: str, value: str, name: str, num: int, den: int, ranges: int | None = None, times: str | None = None) -> DataFrame:
    """key and the value at index min(floor(n * num / den), n - 1) of its n rows in order (nulls first), from running counts of equal values; no key is sorted in one task. A row stands for ``times`` equal ones if that column is given."""
    counts = rows.groupBy(key, value).agg((F.sum(times) if times else F.count("*")).alias("n_"))
    upto = running(counts, [key, value], F.col("n_"), "upto_", ranges)
    totals = upto.groupBy(F.col(key).alias("key_")).agg(F.sum("n_").alias("all_"), F.min(F.col("upto_") - F.col("n_")).alias("base_"))
    index = F.col("base_") + F.least(F.floor(F.col("all_") * num / F.lit(den)), F.col("all_") - 1)
    hit = (F.col("upto_") - F.col("n_") <= index) & (index < F.col("upto_"))
    return upto.join(totals, F.col(key).eqNullSafe(F.col("key_"))).filter(hit).select(key, F.col(value).alias(name))
