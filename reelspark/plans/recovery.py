"""Queries on recovery, acquisition plans, paired runs, stable ids and folder context, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import recovery as op
from reelspark.plans.playback import _NORMAL, _STEP, TAGS, WANTED, _lines, _pick
from reelspark.sources import catalog
from reelspark.sources.catalog import millis, table

FAILURES = list(op.FIRST_RUNG)
NEXT_ID = 1_000_000_000


def recovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failures of users, ten attempts each."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("item"), millis("ts").alias("at"), F.col("event_id").alias("id"), _pick(FAILURES, "cast(event_id / 10 as long) * 5 + user_id").alias("failure"))
    return op.recovery(rows)


def acquisition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders as tracks."""
    rows = _lines(spark, sf_dir).select("item", "idx", _pick(TAGS, "s + idx").alias("tag"), (F.col("r") == "R").alias("forced"), (F.col("f") == "F").alias("sdh"), "fidelity", (F.col("idx") % 3 == 0).alias("bitmap"), (F.col("idx") % 5 == 0).alias("machine"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 3 == 0).alias("captions"), _pick(TAGS, "o_orderkey").alias("audio_tag"))
    return op.acquisition_plan(rows, requests, WANTED, True, False)


def paired_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' orders as two stages of a run."""
    key = F.col("o_orderkey")
    half = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run"), F.when(key % 2 == 0, "baseline").otherwise("composited").alias("stage"))
    stages = half.agg(
        F.when(F.min(key % 10) == 9, 0).otherwise(F.count("*")).alias("n_samples"), F.max(key % 9).cast("double").alias("delayed_per_min"), (F.lit(24.0) - F.min(key % 5) * 0.2).cast("double").alias("mean_fps"),
        F.max(key % 50).cast("double").alias("max_avsync_ms"), F.when(F.count("*") > 1, F.max(key % 13) * F.lit(0.1).cast("double")).alias("mean_cpu"), F.when(F.min(key % 4) > 0, F.min(key % 150)).cast("double").alias("osd_ms"),
    )
    return op.paired_verdicts(stages, 6.0, 3.0, 0.98, 40.0, 0.5, 100.0).withColumn("findings", F.array_join("findings", ","))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """today's paths with yesterday's ids."""
    previous = catalog.files(spark, sf_dir).filter("doc_id % 7 != 0").select("path", F.col("doc_id").alias("id"))
    return op.stable_ids(previous, catalog.snapshots(spark, sf_dir)[1].select("path"), NEXT_ID)


def folder_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of their brands."""
    part, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    files = part.select(
        key.alias("path"), F.col("p_brand").alias("folder"), F.when(key % 7 != 0, F.col("p_name")).otherwise("").alias("title"), F.when(size % 3 == 0, size + 1950).alias("year"), F.array(F.concat(F.lit("a"), key % 5), F.concat(F.lit("b"), size % 3)).alias("ids"),
        F.when(key % 4 != 3, _pick(["absolute", "season_episode", "date"], "p_partkey % 4")).alias("kind"), F.when(key % 4 == 1, size).alias("season"), F.when(key % 4 != 3, F.array(key * 50, key + 1)).alias("numbers"), F.array((size % 4).cast("int"), F.lit(2)).alias("editions"),
    )
    least = F.min("p_partkey")
    folders = part.groupBy(F.col("p_brand").alias("folder")).agg(
        F.when(least % 5 != 0, F.concat(F.min("p_type"), F.lit(" of ever more brass"))).otherwise("").alias("title"), F.when(least % 2 == 0, F.min("p_size") + 1990).alias("year"), F.array(F.lit("a1"), F.lit("c"), F.lit("c")).alias("ids"),
        F.when(least % 3 == 0, "season_only").when(least % 3 == 1, "date").alias("kind"), F.when(least % 3 == 0, F.min("p_size")).alias("season"), F.when(least % 3 == 1, F.array(least)).alias("numbers"), F.array(F.lit(3), F.lit(1)).alias("editions"),
    )
    merged = op.merge_folders(files, folders)
    return merged.select("path", "title", "year", F.array_join("ids", ",").alias("ids"), "kind", "season", F.array_join("numbers", ",").alias("numbers"), F.array_join("editions", ",").alias("editions"))


QUERIES = {f.__name__: f for f in (recovery_outcomes, acquisition_plan, paired_verdicts, stable_ids, folder_context)}

_KINDS = ", ".join(f"({k}, '{name}', {-1 if rung is None else rung})" for k, (name, rung) in enumerate(op.FIRST_RUNG.items()))
_RUNGS = "['" + "', '".join(op.RUNGS) + "']"
_PATH = "source || '/' || lang || '/doc_' || doc_id"

ORACLES: dict[str, str] = {
    # the ladder itself, failure by failure
    "recovery_outcomes": f"""WITH RECURSIVE kinds(k, failure, least) AS (VALUES {_KINDS}),
f AS (SELECT user_id * 10 + event_id % 10 AS item, row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS n, failure, least FROM events JOIN kinds ON k = (event_id // 10 * 5 + user_id) % 14),
walk AS (SELECT DISTINCT item, 0::BIGINT AS n, 0 AS rung, 'open' AS outcome, NULL::VARCHAR AS cause, false AS lost FROM f
  UNION ALL SELECT item, n, CASE WHEN outcome = 'open' THEN up ELSE rung END, outcome, CASE WHEN outcome = 'terminal' THEN failure END, lost OR (outcome = 'open' AND up IN (4, 5, 7, 9, 10))
  FROM (SELECT w.item, f.n, w.rung, w.lost, f.failure, greatest(f.least, w.rung + 1) AS up, CASE WHEN f.least < 0 THEN 'terminal' WHEN w.rung = 10 THEN 'exhausted' ELSE 'open' END AS outcome FROM walk w JOIN f ON f.item = w.item AND f.n = w.n + 1 WHERE w.outcome = 'open'))
SELECT item, max(n) AS n_failures, {_RUNGS}[max(rung) + 1] AS rung, arg_max(outcome, n) AS outcome, max(cause) AS cause, max(rung) > 2 AS degraded, bool_or(lost) AS content_loss FROM walk GROUP BY item""",
    "acquisition_plan": f"""WITH g AS (SELECT l_orderkey AS item, l_partkey AS idx, min(l_suppkey) AS s, min(l_returnflag) AS r, min(l_linestatus) AS f, min(l_quantity)::BIGINT AS fidelity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
t AS (SELECT *, {_NORMAL}[((s + idx) % 8 + 1)::INTEGER] AS tag FROM g), k AS (SELECT *, {_STEP} END AS step FROM t),
c AS (SELECT item, idx, tag, (3 - step // 2) * 1000000 + CASE WHEN step % 2 = 0 THEN 200000 ELSE 100000 END + (r = 'R')::INTEGER * 50000 + (f <> 'F')::INTEGER * 20000 + fidelity * 100 + (idx % 3 <> 0)::INTEGER * 10 AS score FROM k WHERE step IS NOT NULL),
w(pos, want) AS (VALUES (0, 'pt-pt'), (1, 'fr'), (2, 'en')),
steps AS (SELECT item, 0 AS g, -score AS k, CASE WHEN idx % 3 = 0 THEN 'ocr_bitmap' ELSE 'use_existing' END AS step, idx, tag FROM c
  UNION ALL SELECT o_orderkey, 1, pos, 'search_exact', NULL, want FROM orders, w UNION ALL SELECT o_orderkey, 2, pos, 'search_dialect', NULL, want FROM orders, w
  UNION ALL SELECT o_orderkey, 3, 0, 'extract_captions', NULL, NULL FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT item, 4, -fidelity, 'translate', idx, tag FROM t WHERE idx % 3 <> 0 AND r <> 'R' AND idx % 5 <> 0 AND tag <> 'und' AND split_part(tag, '-', 1) <> 'pt'
  UNION ALL SELECT o_orderkey, 5, 0, 'transcribe', NULL, {_NORMAL}[(o_orderkey % 8 + 1)::INTEGER] FROM orders)
SELECT item, row_number() OVER (PARTITION BY item ORDER BY g, k, idx) AS place, step, idx, tag FROM steps""",
    "paired_verdicts": """WITH s AS (SELECT o_custkey AS run, o_orderkey % 2 AS half, CASE WHEN min(o_orderkey % 10) = 9 THEN 0 ELSE count(*) END AS n, max(o_orderkey % 9)::DOUBLE AS late, 24::DOUBLE - min(o_orderkey % 5) * 0.2::DOUBLE AS fps,
  max(o_orderkey % 50)::DOUBLE AS av, CASE WHEN count(*) > 1 THEN max(o_orderkey % 13) * 0.1::DOUBLE END AS cpu, CASE WHEN min(o_orderkey % 4) > 0 THEN min(o_orderkey % 150)::DOUBLE END AS osd FROM orders GROUP BY 1, 2),
p AS (SELECT coalesce(a.run, b.run) AS run, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn, coalesce(a.late, 0) AS alate, round(coalesce(b.late, 0) - coalesce(a.late, 0), 6) AS added_delayed, coalesce(round(coalesce(b.fps, 0) / a.fps, 6), 0) AS ratio, coalesce(b.av, 0) AS av, round(b.cpu - a.cpu, 6) AS added_cpu, b.osd
  FROM (SELECT * FROM s WHERE half = 0) a FULL JOIN (SELECT * FROM s WHERE half = 1) b USING (run)),
v AS (SELECT *, CASE WHEN an = 0 OR bn = 0 THEN 'no_samples' WHEN alate > 6 THEN 'baseline_late' END AS unusable FROM p)
SELECT run, CASE WHEN unusable IS NOT NULL THEN 'inconclusive' WHEN added_delayed > 3 OR ratio < 0.98::DOUBLE OR av > 40 OR coalesce(osd > 100, false) THEN 'fail' WHEN coalesce(added_cpu > 0.5::DOUBLE, false) OR osd IS NULL THEN 'pass_with_notes' ELSE 'pass' END AS outcome,
  added_delayed, ratio, added_cpu, CASE WHEN unusable IS NOT NULL THEN unusable ELSE concat_ws(',', CASE WHEN added_delayed > 3 THEN 'late_presents' ELSE 'late_presents_within_budget' END, CASE WHEN ratio < 0.98::DOUBLE THEN 'frame_rate' END, CASE WHEN av > 40 THEN 'desync' END,
  CASE WHEN added_cpu > 0.5::DOUBLE THEN 'cpu' END, CASE WHEN osd IS NULL THEN 'osd_not_measured' WHEN osd > 100 THEN 'osd_slow' ELSE 'osd_in_time' END) END AS findings FROM v""",
    "stable_ids": f"""WITH old AS (SELECT {_PATH} AS path, doc_id AS id FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' ELSE '' END || {_PATH} AS path FROM documents WHERE doc_id % 13 <> 0)
SELECT path, id, false AS fresh FROM old JOIN new USING (path) UNION ALL SELECT path, {NEXT_ID - 1} + row_number() OVER (ORDER BY string_split(path, '/')), true FROM new WHERE path NOT IN (SELECT path FROM old)""",
    "folder_context": """WITH d AS (SELECT p_brand, CASE WHEN min(p_partkey) % 5 <> 0 THEN min(p_type) || ' of ever more brass' ELSE '' END AS dt, CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_size) + 1990 END AS dy, min(p_partkey) % 3 AS m, min(p_size) AS ds, min(p_partkey) AS dn FROM part GROUP BY 1),
f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END AS ft, CASE WHEN p_size % 3 = 0 THEN p_size + 1950 END AS fy, p_partkey % 5 AS i, p_size % 3 AS j, p_partkey % 4 AS q, p_size, d.* FROM part JOIN d USING (p_brand))
SELECT path, CASE WHEN dt <> '' AND strlen(dt) >= strlen(ft) THEN dt ELSE ft END AS title, coalesce(dy, fy) AS year, 'a' || i || ',b' || j || CASE WHEN i <> 1 THEN ',a1' ELSE '' END || ',c' AS ids,
  CASE WHEN q = 0 AND m = 0 THEN 'season_episode' WHEN q = 3 THEN CASE m WHEN 0 THEN 'season_only' WHEN 1 THEN 'date' END ELSE ['absolute', 'season_episode', 'date'][(q + 1)::INTEGER] END AS kind,
  CASE WHEN q IN (0, 3) AND m = 0 THEN ds WHEN q = 1 THEN p_size END AS season,
  CASE WHEN q = 3 THEN CASE WHEN m = 1 THEN dn::VARCHAR END WHEN q = 0 AND m = 0 THEN least(path * 50, 65535) || ',' || least(path + 1, 65535) ELSE path * 50 || ',' || (path + 1) END AS numbers,
  array_to_string(list_sort(list_concat([p_size % 4, 2], list_filter([3, 1], lambda x: x <> p_size % 4))), ',') AS editions FROM f""",
}
