"""Queries that replay the events as a stream, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.sources.catalog import millis, table
from reelspark.streaming import live


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the cluster names; a local one only where none is set and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="reelspark-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _replayed(spark: SparkSession, sf_dir: str, label: str, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max(millis("ts"))).first()[0] or 0

    def stream(own: SparkSession) -> DataFrame:
        rows = own.readStream.schema(events.schema).parquet(f"{sf_dir}/events.{{parquet}}")  # a pattern: the table may be one file
        return rows.select(F.col("user_id").alias("key"), millis("ts").alias("at_ms"), F.col("event_id").alias("id"))

    return live.replay(stream, rule, spark, scratch(spark, label), last + 1000 * 86_400_000)


def live_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with an hour's debounce and an hour's quiet, on a stream."""
    return _replayed(spark, sf_dir, "bursts", lambda x: live.debounce_quiet(x, 3_600_000, 3_600_000, "1 day"))


def live_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two a day, on a stream."""
    return _replayed(spark, sf_dir, "attempts", lambda x: live.admitted(x, 2, 86_400_000, "1 day"))


QUERIES = {f.__name__: f for f in (live_bursts, live_rate_limit)}

EVENTS = "ev AS (SELECT *, epoch_us(ts) // 1000 AS tm FROM events)"

#: Event by event: the open burst of a key, and how many it has.
BURSTS = f"""WITH RECURSIVE {EVENTS}, n AS (SELECT user_id AS key, tm AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY tm) AS i FROM ev),
walk AS (SELECT key, i, at_ms AS first_ms, at_ms AS last_ms, 1::BIGINT AS n FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.i, CASE WHEN n.at_ms < last_ms + 7200000 THEN first_ms ELSE n.at_ms END, CASE WHEN n.at_ms <= last_ms + 3600000 OR n.at_ms >= last_ms + 7200000 THEN n.at_ms ELSE last_ms END,
    CASE WHEN n.at_ms <= last_ms + 3600000 THEN walk.n + 1 WHEN n.at_ms < last_ms + 7200000 THEN walk.n ELSE 1 END FROM walk JOIN n ON n.key = walk.key AND n.i = walk.i + 1)
SELECT key, first_ms, max(last_ms) AS last_ms, max(n) AS n FROM walk GROUP BY key, first_ms"""
