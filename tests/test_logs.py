"""Tolerant readers on broken, old and blank lines."""

from pyspark.sql import functions as F

from reelspark.plans import logs as plans
from reelspark.plans import statistics
from reelspark.plans.logs import SAMPLE
from reelspark.sources import catalog, logs


def test_log(spark):
    lines = ['{"id": 1, "a": 2.5, "new": "x", "other": []}', '{"id": 2, "a": null}', '{"id": 3, "a": 1', '{"id": "no", "a": 1}', "", "  ", None, "null", "7", "[]", ' {"id": 4, "a": 0.5, "new": "y"} ', '{"id": 5}{']
    frame = spark.createDataFrame([(x, 1) for x in lines], "line string, rejected int")
    got = [tuple(x) for x in logs.parse_log(frame, "id long, a double, new string", {"a": 9.0, "new": "none"}).collect()]
    assert [x for x in got if not x[3]][:3] == [(1, 2.5, "x", False), (2, 9.0, "none", False), (4, 0.5, "y", False)]
    assert sum(x[3] for x in got) >= 5 and all(x[:3] == (None, None, None) for x in got if x[3])
    assert logs.parse_log(frame.limit(0), "id long").collect() == []


def test_labelled_list(spark):
    lines = ["# name\ttitle", "a\tb\tc\td", "a\t\t\t", "too\tfew", "a\tb\tc\td\te", "", None, "x\ty\tz\tw\r"]
    got = [tuple(x) for x in logs.parse_labelled(spark.createDataFrame([(x,) for x in lines], "line string"), ["n", "t", "y", "s"]).collect()]
    assert got == [("a", "b", "c", "d", False), ("a", "", "", "", False), (None,) * 4 + (True,), (None,) * 4 + (True,), ("x", "y", "z", "w", False)]


def test_stage_summary_reads_lines_once(spark):
    line = F.to_json(F.struct((F.col("id") % 3).alias("stage"), (F.col("id") * 10).alias("at_ms"), F.col("id").alias("delayed"), F.col("id").alias("dropped"), F.lit(24.0).alias("fps"), (F.col("id") % 4 / 8).alias("render_ms")))
    log = logs.parse_log(spark.range(600).select(line.alias("line")), SAMPLE)
    out = statistics.stage_summary(log.filter("NOT rejected"), 3000)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x["stage"]: (x["samples"], x["delayed"], x["mean_fps"], x["p99_render_ms"], x["mean_cpu_frac"]) for x in out.collect()}
    assert got == {k: (100, 297, 24.0, 0.375, None) for k in range(3)}


def test_lines_are_spread(spark, tmp_path):
    events = spark.range(40).selectExpr("id event_id", "id % 3 user_id", "timestamp_ntz'2024-01-03 00:00:00' ts", "'{\"k\": 7}' props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert plans._events(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    assert catalog.spread(spark.range(100).coalesce(1), 10).rdd.getNumPartitions() == 11
