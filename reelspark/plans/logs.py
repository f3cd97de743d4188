"""Queries on logs and bundles with the columns of the survey's rules, made from keys of the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import library, metadata, subtitles
from reelspark.plans import statistics
from reelspark.sources import catalog, logs
from reelspark.sources.catalog import millis, table

SESSION = (
    "id long, predicted_hardware_decode boolean, observed_hwdec string, dropped_frames long, seconds_played double, expected_fps double, "
    "predicted_audio_passthrough boolean, observed_audio_out_format string"
)
SAMPLE = "id long, stage long, at_ms long, delayed long, dropped long, fps double, avsync_s double, render_ms double, cpu_frac double"
_START = 1_704_067_200_000


def _lines(rows: DataFrame, newer: list[str]) -> DataFrame:
    """A log of the rows: some lines are cut off, some hold text where a number belongs, some are blank, and some lack the newer columns."""
    i = F.col("id")
    old = F.to_json(F.struct(*(c for c in rows.columns if c not in newer)))
    rows = rows.select("id", F.explode(F.array(F.when(i % 5 == 0, old).otherwise(F.to_json(F.struct(*rows.columns))))).alias("line"))
    line = F.when(i % 17 == 0, F.left("line", F.length("line") - 3)).when(i % 19 == 0, F.replace("line", F.lit('"id":'), F.lit('"id":"x'))).otherwise(F.col("line"))
    return rows.select(F.when(i % 23 == 0, " ").otherwise(line).alias("line"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their counter k read once, spread: lines are dearer to write and parse than events are to read."""
    rows = catalog.spread(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props"))
    return rows.select("event_id", "user_id", "ts", F.explode(F.array(F.get_json_object("props", "$.k").cast("long"))).alias("k"))


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log read tolerantly, and how its predictions did; rejected lines are counted."""
    k, i = F.col("k"), F.col("event_id")
    rows = _events(spark, sf_dir).select(
        i.alias("id"), (F.col("user_id") % 3 == 0).alias("predicted_hardware_decode"), F.when(k % 4 == 0, "no").when(k % 4 == 1, "").when(k % 4 == 2, "vaapi").alias("observed_hwdec"),
        k.alias("dropped_frames"), (k % 10 / 2.0).alias("seconds_played"), F.when(k % 5 == 0, 0.0).when(k % 5 > 1, 25.0 * (1 + k)).alias("expected_fps"),
        (i % 2 == 0).alias("predicted_audio_passthrough"), F.when(k % 6 == 0, "spdif-ac3").when(k % 6 == 1, "s16").alias("observed_audio_out_format"),
    )
    log = logs.parse_log(_lines(rows, ["dropped_frames", "observed_audio_out_format"]), SESSION, {"dropped_frames": 0})
    checks = statistics.calibration_checks(log.filter("NOT rejected"))
    return checks.crossJoin(F.broadcast(log.agg(F.count_if("rejected").alias("rejected"))))


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a log read tolerantly, and each stage's summary after a day of warming up."""
    k, i = F.col("k"), F.col("event_id")
    rows = _events(spark, sf_dir).select(
        i.alias("id"), F.col("user_id").alias("stage"), (millis("ts") - _START).alias("at_ms"), (k + i % 100).alias("delayed"), k.alias("dropped"), (k % 7 * 1.0).alias("fps"),
        ((k - 50) / 1024.0).alias("avsync_s"), (k * 3 % 50 * 0.5).alias("render_ms"), (k / 128.0).alias("cpu_frac"),
    )
    log = logs.parse_log(_lines(rows, ["render_ms", "cpu_frac"]), SAMPLE)
    out = statistics.stage_summary(log.filter("NOT rejected"), 86_400_000)
    return out.select("stage", "samples", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty files after the first hundred."""
    return library.page(catalog.files(spark, sf_dir), 100, 50).select("path", "position", "total")


def bundle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments merged into bundles, by the default order and one group's own; locked fields stay."""
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        i.alias("i"), F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("field_group"), F.concat(F.lit("f"), i % 5).alias("name"),
        F.when(i % 9 == 0, "  ").otherwise(F.concat(F.lit("v"), i % 97)).alias("value"), F.when(i % 13 == 0, 2).when(i % 17 == 0, 0).otherwise(1).alias("kind"), F.col("o_orderpriority").alias("provider"),
    )
    base = rows.filter("i % 10 = 0").withColumns({"kind": (F.col("i") % 4).cast("int"), "rank": F.lit(1), "locked": F.col("i") % 50 == 0})
    default = [(None, p, n) for n, p in enumerate(["2-HIGH", "1-URGENT", "3-MEDIUM"])]
    ranking = spark.createDataFrame([*default, ("F", "5-LOW", 0), ("F", "3-MEDIUM", 1)], "field_group string, provider string, pos int")
    return metadata.merge_fragments(base, rows.filter("i % 10 != 0"), ranking)


def cue_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every turn of the conversations as a cue, in at most three lines."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", subtitles.wrapped(F.col("text"), 42, 3).alias("wrapped"))


QUERIES = {f.__name__: f for f in (calibration_report, stage_report, library_page, bundle_merge, cue_wrap)}

_LOGGED = """ev AS (
  SELECT event_id AS i, user_id, epoch_us(ts) // 1000 AS tm, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 23 <> 0
), fine AS (
  SELECT *, i % 5 = 0 AS old FROM ev WHERE i % 17 <> 0 AND i % 19 <> 0
)"""

ORACLES = {
    "calibration_report": f"""WITH {_LOGGED}, s AS (
  SELECT user_id % 3 = 0 AS hw, CASE k % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true END AS seen, CASE WHEN old THEN 0 ELSE k END AS dropped, k % 10 / 2.0::DOUBLE AS secs,
    CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 > 1 THEN 25.0 * (1 + k) END::DOUBLE AS fps, i % 2 = 0 AS pass, CASE WHEN old THEN NULL WHEN k % 6 = 0 THEN true WHEN k % 6 = 1 THEN false END AS spdif FROM fine
), c AS (
  SELECT 'hardware_decode' AS "check", hw = seen AS ok FROM s
  UNION ALL SELECT 'drop_rate', CASE WHEN fps > 0 AND secs >= 2 THEN dropped / (fps * secs) <= 0.02::DOUBLE END FROM s
  UNION ALL SELECT 'audio_passthrough', pass = spdif FROM s
)
SELECT "check", count(*) AS n, count(ok) AS checkable, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS missed, (SELECT count(*) FROM ev WHERE i % 17 = 0 OR i % 19 = 0) AS rejected FROM c GROUP BY "check\"""",
    "stage_report": f"""WITH {_LOGGED}, s AS (
  SELECT user_id AS stage, tm - {_START} AS at_ms, k + i % 100 AS delayed, k AS dropped, k % 7 * 1.0::DOUBLE AS fps, (k - 50) / 1024.0::DOUBLE AS sync, CASE WHEN NOT old THEN k * 3 % 50 * 0.5::DOUBLE END AS render,
    CASE WHEN NOT old THEN k / 128.0::DOUBLE END AS cpu FROM fine
), w AS (
  SELECT * FROM s WHERE at_ms >= 86400000
), p AS (
  SELECT stage, render, row_number() OVER (PARTITION BY stage ORDER BY render) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM w WHERE render IS NOT NULL
), p99 AS (
  SELECT stage, render FROM p WHERE i = least(n * 99 // 100, n - 1)
), a AS (
  SELECT stage, count(*) AS samples, min({{'at': at_ms, 'delayed': delayed, 'dropped': dropped}}) AS a, max({{'at': at_ms, 'delayed': delayed, 'dropped': dropped}}) AS b, avg(fps) FILTER (fps > 0) AS fps, max(abs(sync)) * 1000 AS sync, avg(cpu) AS cpu FROM w GROUP BY stage
), d AS (
  SELECT *, (b.at - a.at) / 1000.0::DOUBLE AS sec FROM a
), every AS (
  SELECT DISTINCT stage FROM s
)
SELECT e.stage, coalesce(samples, 0) AS samples, round(CASE WHEN sec > 0 THEN sec ELSE 0.0 END, 6) AS duration_s, CASE WHEN sec > 0 THEN greatest(b.delayed - a.delayed, 0) ELSE 0 END AS delayed,
  CASE WHEN sec > 0 THEN greatest(b.dropped - a.dropped, 0) ELSE 0 END AS dropped, round(CASE WHEN sec > 0 THEN greatest(b.delayed - a.delayed, 0) * 60.0::DOUBLE / sec ELSE 0.0 END, 6) AS delayed_per_min,
  round(CASE WHEN sec > 0 THEN coalesce(fps, 0.0) ELSE 0.0 END, 6) AS mean_fps, round(CASE WHEN sec > 0 THEN coalesce(sync, 0.0) ELSE 0.0 END, 6) AS max_avsync_ms,
  round(CASE WHEN sec > 0 THEN render END, 6) AS p99_render_ms, round(CASE WHEN sec > 0 THEN cpu END, 6) AS mean_cpu_frac
FROM every e LEFT JOIN d ON d.stage = e.stage LEFT JOIN p99 ON p99.stage = e.stage""",
    "library_page": """WITH f AS (
  SELECT source || '/' || lang || '/doc_' || doc_id AS path FROM documents
), o AS (
  SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position, count(*) OVER () AS total FROM f
)
SELECT * FROM o WHERE position > 100 AND position <= 150""",
    "bundle_merge": """WITH rows AS (
  SELECT o_orderkey AS i, o_custkey AS item, o_orderstatus AS field_group, 'f' || o_orderkey % 5 AS name, CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE 'v' || o_orderkey % 97 END AS value,
    CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 4 WHEN o_orderkey % 13 = 0 THEN 2 WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END::INTEGER AS kind, o_orderpriority AS provider, o_orderkey % 50 = 0 AS locked FROM orders
), ranked AS (
  SELECT *, CASE WHEN i % 10 = 0 THEN 1 WHEN field_group = 'F' THEN CASE provider WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 127 END
    ELSE CASE provider WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 127 END END AS rank FROM rows WHERE i % 10 = 0 OR trim(value) <> ''
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item, field_group, name ORDER BY locked DESC, kind DESC, CASE WHEN kind = 1 THEN -rank ELSE 0 END DESC, CASE WHEN kind = 1 THEN provider ELSE '' END DESC, value DESC) AS place FROM ranked
)
SELECT item, field_group, name, value, kind, CASE WHEN kind = 1 THEN provider END AS provider, locked FROM placed WHERE place = 1""",
    # word by word: the lines done, how many, and the one begun
    "cue_wrap": r"""WITH RECURSIVE w AS (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM conversations
), t AS (
  SELECT *, length(array_to_string(words, ' ')) AS total FROM w
), walk(conv_id, turn, i, done, n, line) AS (
  SELECT conv_id, turn, 0::BIGINT, '', 0, '' FROM t
  UNION ALL SELECT s.conv_id, s.turn, s.i + 1, CASE WHEN b THEN CASE WHEN n > 0 THEN done || chr(10) ELSE '' END || line ELSE done END, CASE WHEN b THEN n + 1 ELSE n END, CASE WHEN b OR line = '' THEN word ELSE line || ' ' || word END
  FROM (SELECT walk.*, words[i + 1] AS word, line <> '' AND (length(line) + 1 + length(words[i + 1]) > 42
      OR length(line) >= ceil(total / greatest(ceil(total / 42.0::DOUBLE), 1.0)) AND right(line, 1) IN (',', '.', '!', '?', ';', ':', '—')) AS b
    FROM walk JOIN t USING (conv_id, turn) WHERE i < len(words) AND n < 3 AND total > 42) s
), ends AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS place FROM walk
)
SELECT conv_id, turn, CASE WHEN words IS NULL THEN NULL WHEN total <= 42 THEN array_to_string(words, ' ') WHEN n >= 3 OR line = '' THEN done WHEN n > 0 THEN done || chr(10) || line ELSE line END AS wrapped
FROM ends JOIN t USING (conv_id, turn) WHERE place = 1""",
    # all differences within the window, the fullest bucket of 50 ms, and its median by floored index
    "track_offsets": """WITH ev AS (
  SELECT user_id AS track, epoch_us(ts) // 1000 AS tm, event_type FROM events
), d AS (
  SELECT c.track, s.tm - c.tm AS diff, (s.tm - c.tm - ((s.tm - c.tm) % 50 + 50) % 50) // 50 AS bucket FROM ev c JOIN ev s ON s.track = c.track AND s.tm BETWEEN c.tm - 6000000 AND c.tm + 6000000 WHERE c.event_type = 'click' AND s.event_type = 'view'
), b AS (
  SELECT track, bucket, count(*) AS n_pairs FROM d GROUP BY track, bucket
), best AS (
  SELECT *, row_number() OVER (PARTITION BY track ORDER BY n_pairs DESC, abs(bucket), bucket DESC) AS place FROM b
), m AS (
  SELECT d.track, d.diff, best.n_pairs, row_number() OVER (PARTITION BY d.track ORDER BY d.diff) - 1 AS i FROM d JOIN best ON best.track = d.track AND best.bucket = d.bucket AND place = 1
)
SELECT track, diff AS offset_ms, n_pairs FROM m WHERE i = n_pairs // 2""",
}
