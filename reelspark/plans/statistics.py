"""Statistics of playback sessions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranges import at_share, lagged, written


def stage_stats(samples: DataFrame) -> DataFrame:
    """Of each stage (stage, at_ms, id, counter, value) its duration, counter gain (falls count as none), mean and 99th value."""
    rows = lagged(samples.select("stage", "at_ms", "id", "counter", "value"), "stage", ["at_ms", "id"], ["counter"])
    rows = rows.withColumn("gain", F.greatest(F.col("counter") - F.col("before_counter"), F.lit(0)))
    p99 = at_share(samples, "stage", "value", "p99_value", 99, 100).withColumnRenamed("stage", "stage_")
    # summed as decimals, so that the order of rows cannot change the mean
    mean = F.round((F.sum(F.col("value").cast("decimal(28,12)")).cast("double") / F.count("value")), 6)
    sums = rows.groupBy("stage").agg((F.max("at_ms") - F.min("at_ms")).alias("duration_ms"), F.sum(F.coalesce("gain", F.lit(0))).cast("long").alias("gain"), mean.alias("mean_value"))
    return sums.join(p99, F.col("stage").eqNullSafe(F.col("stage_"))).select("stage", "duration_ms", "gain", "mean_value", "p99_value")


def calibration(events: DataFrame, flagged_above: int) -> DataFrame:
    """for each kind the rows with a readable counter, and those above the limit."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("checkable"), F.sum((k > flagged_above).cast("long")).alias("flagged"))


def stage_summary(samples: DataFrame, warmup_ms: int = 0) -> DataFrame:
    """Of each stage (stage, at_ms, delayed, dropped, fps, avsync_s, render_ms, cpu_frac) its steady samples, from ``warmup_ms`` on.

    Cumulative counters go from the first to the last sample (a fall counts as none); the mean frame rate is over finite positive rates; the
    99th render time is by floored index. Where the samples last no time all but their number is 0 or null.
    """
    steady = F.col("at_ms") >= warmup_ms

    def finite(c: str) -> Column:
        return F.when(steady & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))

    # read once: rows of one stage and render time are summed up and written, and all else comes from those
    ends, fps, cpu = F.struct("at_ms", "delayed", "dropped"), F.when(finite("fps") > 0, F.col("fps")), finite("cpu_frac")
    parts = written(samples.groupBy("stage", finite("render_ms").alias("render")).agg(
        F.count("*").alias("times"), F.count(F.when(steady, 1)).alias("samples"), F.min(F.when(steady, ends)).alias("a"), F.max(F.when(steady, ends)).alias("b"), F.sum(fps).alias("fps"), F.count(fps).alias("n_fps"),
        F.max(F.abs(finite("avsync_s")) * 1000.0).alias("sync"), F.sum(cpu).alias("cpu"), F.count(cpu).alias("n_cpu"),
    ))
    p99 = at_share(parts.filter("render IS NOT NULL"), "stage", "render", "p99", 99, 100, times="times").withColumnRenamed("stage", "stage_")
    out = parts.groupBy("stage").agg(
        F.sum("samples").alias("samples"), F.min("a").alias("a"), F.max("b").alias("b"), F.try_divide(F.sum("fps"), F.sum("n_fps")).alias("fps"), F.max("sync").alias("sync"), F.try_divide(F.sum("cpu"), F.sum("n_cpu")).alias("cpu"),
    )
    out = out.join(p99, F.col("stage").eqNullSafe(F.col("stage_")), "left").drop("stage_")
    seconds = (F.col("b.at_ms") - F.col("a.at_ms")) / 1000.0
    gain = {c: F.greatest(F.col(f"b.{c}") - F.col(f"a.{c}"), F.lit(0)) for c in ("delayed", "dropped")}

    def known(c: Column, otherwise: object = None) -> Column:
        return F.when(seconds > 0, c).otherwise(F.lit(otherwise))

    return out.select(
        "stage", "samples", known(seconds, 0.0).alias("duration_s"), known(gain["delayed"], 0).alias("delayed"), known(gain["dropped"], 0).alias("dropped"), known(gain["delayed"] * 60.0 / seconds, 0.0).alias("delayed_per_min"),
        known(F.coalesce("fps", F.lit(0.0)), 0.0).alias("mean_fps"), known(F.coalesce("sync", F.lit(0.0)), 0.0).alias("max_avsync_ms"), known(F.col("p99")).alias("p99_render_ms"), known(F.col("cpu")).alias("mean_cpu_frac"),
    )


def calibration_checks(log: DataFrame, above: float = 0.02, seconds: float = 2.0) -> DataFrame:
    """How many sessions of a calibration log can be checked, and how many went as predicted or missed, for each of three checks.

    log: predicted_hardware_decode, observed_hwdec, dropped_frames, seconds_played, expected_fps, predicted_audio_passthrough,
    observed_audio_out_format. What is null cannot be checked; nor can the drop rate of a session shorter than ``seconds`` or without a
    positive frame rate. A drop rate above the limit is a miss (a flag). Returns check, n, checkable, matched, missed.
    """
    hardware = F.col("predicted_hardware_decode") == ((F.col("observed_hwdec") != "") & (F.col("observed_hwdec") != "no"))
    judged = (F.col("expected_fps") > 0) & ~F.isnan("expected_fps") & (F.col("seconds_played") >= seconds)
    drops = F.when(judged, F.col("dropped_frames") / (F.col("expected_fps") * F.col("seconds_played")) <= above)
    passthrough = F.col("predicted_audio_passthrough") == F.col("observed_audio_out_format").startswith("spdif-")
    checks = {"hardware_decode": hardware, "drop_rate": drops, "audio_passthrough": passthrough}
    out = log.agg(F.count("*").alias("n"), *(F.struct(F.count(c).alias("checkable"), F.count_if(c).alias("matched"), F.count_if(~c).alias("missed")).alias(k) for k, c in checks.items()))
    rows = out.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), f"{k}.*") for k in checks))).alias("x"))
    return rows.select("x.check", "n", "x.checkable", "x.matched", "x.missed")


def coverage(rows: DataFrame) -> DataFrame:
    """Labelled against all for each group, with a grand total row."""
    out = rows.rollup("grp").agg(F.count("*").alias("n"), F.count("label").alias("defined"), F.grouping("grp").alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("grp")).alias("grp"), "n", "defined", F.round(F.col("defined") * 100.0 / F.col("n"), 4).alias("percent"))
