"""The catalog's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.text import human_size, title_key, weighted_rating, year_agreement
from reelspark.operators import library, matching, metadata, snapshot, subtitles
from reelspark.plans import index, ladders, live, logs, playback, recovery, scan, statistics, tree
from reelspark.sources import catalog
from reelspark.sources.catalog import millis, table
from reelspark.streaming import changes

RANKING = [("1-URGENT", 0), ("2-HIGH", 1), ("3-MEDIUM", 2), ("4-NOT SPECIFIED", 3)]


def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.logical_items(catalog.files(spark, sf_dir))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.duplicate_groups(catalog.files(spark, sf_dir))


def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.totals(catalog.files(spark, sf_dir))


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(catalog.files(spark, sf_dir), "Src3/").select("doc_id", "path")


def library_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.name_order(catalog.files(spark, sf_dir)).select("path", "position")


def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return library.tree_totals(leaves, ["r_name", "n_name"], "c_acctbal")


def snapshot_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.reconcile(*catalog.snapshots(spark, sf_dir))


def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts counted."""
    return snapshot_reconcile(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def _verify_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    files = catalog.files(spark, sf_dir).join(labels, "doc_id", "left")
    tier = F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull(), 1).otherwise(2)
    return files.select("path", tier.alias("tier"), "size")


def verify_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.verify_within(_verify_queue(spark, sf_dir), 1_000_000)


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("used"), F.round(F.col("o_totalprice")).cast("long").alias("size"), (F.col("o_orderkey") % 10 == 0).cast("int").alias("readers"))
    return snapshot.evict(entries, F.lit("2001-01-01").cast("date"), 2000, 500_000_000)


def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.merge_fields(catalog.fragments(spark, sf_dir), spark.createDataFrame(RANKING, "provider string, pos int"))


def artwork_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.best_artwork(catalog.artwork(spark, sf_dir))


def cue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.cue_checks(catalog.cues(spark, sf_dir))


def cue_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.readability(catalog.cues(spark, sf_dir))


def repetition_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), millis("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("value"))
    return subtitles.repetition_loops(events, 3)


def onset_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), millis("ts").alias("at"), F.col("event_id").alias("id"), "event_type")
    return subtitles.nearest(at.filter("event_type = 'click'"), at.filter("event_type = 'view'"), 6_000_000)


def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = F.get_json_object("props", "$.k").cast("long")
    return statistics.stage_stats(table(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), millis("ts").alias("at_ms"), F.col("event_id").alias("id"), counter.alias("counter"), "value"))


def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.calibration(table(spark, sf_dir, "events"), 50)


def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return statistics.coverage(rows.select(F.col("lang").alias("grp"), F.col("quality").alias("label")))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F11 (sizes), F25, F27 on parts."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", title_key(F.concat(F.lit("The "), "p_name", F.lit(" & Été"))).alias("title"), human_size(F.col("p_retailprice").cast("long") * 1000 * F.col("p_size")).alias("size"), year_agreement(F.col("p_size"), F.lit(20)).alias("agreement"), F.round(weighted_rating(F.when(F.col("p_size") > 10, F.col("p_size") / 5.0), F.col("p_size")), 6).alias("rating"))


def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title_key(F.col("p_name")).alias("title"), (F.col("p_retailprice").cast("long")).alias("runtime"), "p_brand", "p_size")
    return matching.best_candidates(part, part, ["p_brand", "p_size"])


def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, F26, O4, W6 on parts, each against all others."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title_key(F.col("p_name")).alias("title"), (F.col("p_size") + 1970).alias("year"), F.col("p_retailprice").cast("long").alias("runtime"), (F.col("p_partkey") % 101).cast("double").alias("popularity"), F.lit(None).cast("array<string>").alias("alternates"))
    return matching.ranked_candidates(part, part, itself=False)


def change_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    bursts = changes.debounce(events, "1 hour")
    return bursts.select("key", millis("cast(first as timestamp_ntz)").alias("first_ms"), millis("cast(last as timestamp_ntz)").alias("last_ms"), "n")


def quiet_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with an hour's debounce and an hour's quiet."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), millis("ts").alias("at_ms"))
    return changes.debounce_quiet(events, 3_600_000, 3_600_000)


def track_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as cues, views as speech."""
    at = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), millis("ts").alias("at"), "event_type")
    return subtitles.estimate_offsets(at.filter("event_type = 'click'"), at.filter("event_type = 'view'"), 6_000_000)


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), millis("ts").alias("at_ms"), F.col("event_id").alias("id"))
    return changes.admitted(events, 2, 86_400_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        library_items, duplicate_groups, library_totals, library_search, library_order, tree_totals, snapshot_reconcile, snapshot_report,
        verify_budget, cache_eviction, field_merge, artwork_choice, cue_checks, cue_readability, repetition_loops, onset_offsets,
        stage_stats, calibration_summary, coverage_rollup, title_keys, title_matches, title_candidates, change_bursts, quiet_bursts, track_offsets, rate_limit,
    )
} | playback.QUERIES | ladders.QUERIES | recovery.QUERIES | live.QUERIES | tree.QUERIES | index.QUERIES | logs.QUERIES | scan.QUERIES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id AS path, source AS title, lang AS kind, n_chars AS size, md5(text) AS sketch, text FROM documents)"
_CUES = "cues AS (SELECT conv_id AS track, turn AS tm, turn * 4000 - CASE WHEN turn % 5 = 4 THEN 6000 ELSE 0 END AS start_ms, turn * 4000 - CASE WHEN turn % 5 = 4 THEN 6000 ELSE 0 END + 1500 + length(text) % 60 * 60 AS end_ms, text FROM conversations)"
_RECONCILE = f"""{_FILES}, old AS (SELECT path, size, sketch FROM files WHERE doc_id % 7 <> 0),
new AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, sketch FROM files WHERE doc_id % 13 <> 0),
missing AS (SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)), fresh AS (SELECT * FROM new WHERE path NOT IN (SELECT path FROM old)),
moves AS (SELECT min(f.path) AS path, max(m.path) AS from_path FROM fresh f JOIN missing m USING (sketch) GROUP BY sketch),
verdicts AS (
  SELECT n.path, CASE WHEN o.size = n.size AND o.sketch = n.sketch THEN 'unchanged' ELSE 'modified' END AS verdict, NULL::VARCHAR AS from_path FROM new n JOIN old o USING (path)
  UNION ALL SELECT f.path, CASE WHEN m.path IS NULL THEN 'new' ELSE 'moved' END, m.from_path FROM fresh f LEFT JOIN moves m ON m.path = f.path
  UNION ALL SELECT path, 'tombstoned', NULL FROM missing WHERE path NOT IN (SELECT from_path FROM moves))"""
_EVENTS = "ev AS (SELECT user_id, epoch_us(ts) // 1000 AS tm, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_TITLE = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an|der|die|das|le|la|les|el|los|las|il|lo) ', ''), ' (the|a|an|der|die|das|le|la|les|el|los|las|il|lo)$', '')"
_HUMAN = "CASE WHEN {0} >= 1073741824 THEN format('{{:.1f}} GiB', round({0} / 1073741824.0::DOUBLE, 1)) WHEN {0} >= 1048576 THEN format('{{:.1f}} MiB', round({0} / 1048576.0::DOUBLE, 1)) WHEN {0} >= 1024 THEN format('{{:.1f}} KiB', round({0} / 1024.0::DOUBLE, 1)) ELSE {0} || ' B' END"

ORACLES: dict[str, str] = {
    "library_items": f"WITH {_FILES} SELECT {_LOWER.format('title')} AS item, kind, arg_min(title, path) AS title, count(*) AS n_files, sum(size)::BIGINT AS bytes, min(path) AS first_path FROM files GROUP BY 1, 2",
    "duplicate_groups": f"WITH {_FILES} SELECT sketch, count(*) AS n_files, min(path) AS first_path, (count(*) - 1) * max(size) AS recoverable FROM files GROUP BY sketch HAVING count(*) > 1",
    "library_totals": f"WITH {_FILES}, t AS (SELECT coalesce(kind, 'unidentified') AS kind, count(*) AS n_files, count(DISTINCT {_LOWER.format('title')}) AS n_items, sum(size)::BIGINT AS bytes FROM files GROUP BY 1) SELECT *, {_HUMAN.format('bytes')} AS label FROM t",
    "library_search": f"WITH {_FILES} SELECT doc_id, path FROM files WHERE contains({_LOWER.format('title')}, 'src3/') OR contains({_LOWER.format('path')}, 'src3/')",
    "library_order": f"WITH {_FILES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM files",
    "tree_totals": "SELECT concat_ws('/', 'root', r_name, n_name) AS node, (2 - grouping(r_name) - grouping(n_name))::INTEGER AS depth, count(*) AS n_leaves, round(sum(c_acctbal), 2) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "snapshot_reconcile": f"WITH {_RECONCILE} SELECT path, verdict, from_path FROM verdicts",
    "snapshot_report": f"WITH {_RECONCILE} SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict",
    "verify_budget": f"WITH {_FILES}, q AS (SELECT path, CASE WHEN toxic = 1 THEN 0 WHEN toxic IS NULL THEN 1 ELSE 2 END::INTEGER AS tier, size FROM files LEFT JOIN labels USING (doc_id)), r AS (SELECT *, (sum(size) OVER (ORDER BY tier, path ROWS UNBOUNDED PRECEDING))::BIGINT AS running, row_number() OVER (ORDER BY tier, path) AS n FROM q), s AS (SELECT *, max(CASE WHEN n > 1 THEN running ELSE 0 END) OVER (ORDER BY n) AS most FROM r) SELECT path, tier, size, running FROM s WHERE n = 1 OR most <= 1000000",
    "cache_eviction": "WITH e AS (SELECT o_orderkey AS id, o_orderdate::DATE AS used, round(o_totalprice)::BIGINT AS size, o_orderkey % 10 = 0 AS busy FROM orders), old AS (SELECT * FROM e WHERE NOT busy AND date_diff('day', used, DATE '2001-01-01') > 2000), kept AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM old)), r AS (SELECT id, sum(size) OVER (ORDER BY used, id) - size AS before FROM kept WHERE NOT busy) SELECT id, 'age' AS reason FROM old UNION ALL SELECT id, 'capacity' FROM r WHERE (SELECT sum(size) FROM kept) - before > 500000000",
    "field_merge": "WITH f AS (SELECT o_custkey AS item, o_orderpriority AS provider, o_orderstatus AS field, 'v' || o_orderkey % 97 AS value, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 127 END AS rank FROM orders WHERE o_orderkey % 9 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY rank, value, provider) AS n FROM f), c AS (SELECT item, field, count(DISTINCT provider) AS n_providers FROM f GROUP BY ALL) SELECT item, field, value, provider, n_providers FROM r JOIN c USING (item, field) WHERE n = 1",
    "artwork_choice": "WITH a AS (SELECT l_partkey AS item, l_returnflag AS kind, l_linenumber % 3 AS p, CASE WHEN l_quantity % 10 <> 0 THEN round(l_discount * 100, 0) END AS rating, l_quantity::BIGINT AS votes, l_suppkey % 5 * 400 + 400 AS width, 'art-' || l_orderkey || '-' || l_linenumber AS url FROM lineitem), s AS (SELECT *, floor((coalesce(rating, 5.0) * votes + 50.0) / (votes + 10) * 1000)::BIGINT AS score FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY p, score DESC, width DESC, url) AS n FROM s) SELECT item, kind, url, width, score FROM r WHERE n = 1",
    "cue_checks": f"WITH {_CUES}, r AS (SELECT *, lag(start_ms) OVER w AS bs, lag(end_ms) OVER w AS be FROM cues WINDOW w AS (PARTITION BY track ORDER BY tm)), i AS (SELECT track, tm AS cue, CASE WHEN start_ms < bs THEN 'out_of_order' WHEN start_ms < be THEN 'overlap' WHEN start_ms - be < 80 THEN 'gap' END AS issue FROM r) SELECT * FROM i WHERE issue IS NOT NULL",
    "cue_readability": f"WITH {_CUES}, c AS (SELECT track, round(length(regexp_replace(text, '<[^>]*>', '', 'g')) * 1000.0::DOUBLE / (end_ms - start_ms), 6) AS cps FROM cues WHERE end_ms > start_ms), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY cps) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM c) SELECT track, round(avg(cps), 4) AS mean_cps, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN cps END) AS p95_cps, round(avg((cps > 17.0)::INTEGER::DOUBLE), 4) AS issue_rate FROM r GROUP BY track",
    "repetition_loops": f"WITH {_EVENTS}, a AS (SELECT user_id AS track, tm, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w AND trim(event_type) <> '' THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY tm, event_id) AS run FROM a) SELECT track, min(tm) AS first, count(*) AS n, min(event_type) AS value FROM b GROUP BY track, run HAVING count(*) >= 3",
    "onset_offsets": f"WITH {_EVENTS}, p AS (SELECT c.event_id AS id, v.tm - c.tm AS d FROM ev c JOIN ev v USING (user_id) WHERE c.event_type = 'click' AND v.event_type = 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(d), d) AS n FROM p) SELECT id, d AS offset_ms, floor(d / 50.0)::BIGINT AS bucket FROM r WHERE n = 1 AND abs(d) <= 6000000",
    "stage_stats": f"WITH {_EVENTS}, g AS (SELECT user_id AS stage, tm, value, greatest(k - lag(k) OVER (PARTITION BY user_id ORDER BY tm, event_id), 0) AS gain, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(k) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS b FROM ev) SELECT stage, max(tm) - min(tm) AS duration_ms, sum(CASE WHEN b IS NULL THEN 0 ELSE gain END)::BIGINT AS gain, round(sum(value::DECIMAL(28,12))::DOUBLE / count(value), 6) AS mean_value, max(CASE WHEN i = least(n * 99 // 100, n - 1) THEN value END) AS p99_value FROM g GROUP BY stage",
    "calibration_summary": f"WITH {_EVENTS} SELECT event_type, count(*) AS n, count(k) AS checkable, sum((k > 50)::BIGINT)::BIGINT AS flagged FROM ev GROUP BY event_type",
    "coverage_rollup": "SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS grp, count(*) AS n, count(quality) AS defined, round(count(quality) * 100.0::DOUBLE / count(*), 4) AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "title_keys": f"SELECT p_partkey, {_TITLE.format(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ' & Été' + chr(39))} AS title, {_HUMAN.format('(trunc(p_retailprice)::BIGINT * 1000 * p_size)')} AS size, CASE abs(p_size - 20) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS agreement, round((coalesce(CASE WHEN p_size > 10 THEN p_size / 5.0::DOUBLE END, 5.0) * p_size + 50.0) / (p_size + 10), 6) AS rating FROM part",
    "title_matches": f"""WITH p AS (SELECT p_partkey AS id, {_TITLE.format('p_name')} AS title, trunc(p_retailprice)::BIGINT AS runtime, p_brand, p_size FROM part),
pairs AS (SELECT q.id AS query, c.id AS candidate, q.title AS a, c.title AS b, abs(q.runtime - c.runtime) / nullif(least(q.runtime, c.runtime)::DOUBLE, 0) AS off,
  list_distinct(string_split(q.title, ' ')) AS x, list_distinct(string_split(c.title, ' ')) AS y, greatest(length(q.title), length(c.title)) AS longest, levenshtein(q.title, c.title) AS d FROM p q JOIN p c USING (p_brand, p_size) WHERE q.id <> c.id),
s AS (SELECT query, candidate, round(0.7::DOUBLE * CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE greatest(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), CASE WHEN d <= longest * 2 // 5 THEN 1.0::DOUBLE - d / longest::DOUBLE ELSE 0.0 END) END
  + 0.3::DOUBLE * coalesce(CASE WHEN off <= 0.02::DOUBLE THEN 1.0 WHEN off >= 0.25::DOUBLE THEN 0.0 ELSE (0.25::DOUBLE - off) / 0.23::DOUBLE END, 0.0), 6) AS score FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS n FROM s WHERE score >= 0.45),
t AS (SELECT query, max(CASE WHEN n = 1 THEN candidate END) AS candidate, max(CASE WHEN n = 1 THEN score END) AS score, max(CASE WHEN n = 2 THEN score END) AS second FROM r WHERE n <= 2 GROUP BY query)
SELECT query, candidate, score, round(score - coalesce(second, 0.0), 6) AS margin, CASE WHEN score >= 0.8 AND (second IS NULL OR round(score - coalesce(second, 0.0), 6) > 0.08) THEN 'matched' ELSE 'ambiguous' END AS verdict FROM t""",
    # every pair of parts; similarities once for each two titles
    "title_candidates": f"""WITH p AS (SELECT p_partkey AS id, {_TITLE.format('p_name')} AS title, p_size + 1970 AS year, trunc(p_retailprice)::BIGINT AS runtime, (p_partkey % 101)::DOUBLE AS popularity FROM part),
w AS (SELECT title, length(title) AS n, string_split(title, ' ') AS words FROM (SELECT DISTINCT title FROM p)),
v AS (SELECT title, n, words, list_transform(range(1, len(words) + 1), lambda i: words[i] || ' ' || len(list_filter(words[1:i], lambda y: y = words[i]))) AS marked FROM w),
like_ AS (SELECT a.title AS q_title, b.title AS c_title, CASE WHEN a.title = b.title THEN 1.0::DOUBLE WHEN a.title = '' OR b.title = '' THEN 0.0::DOUBLE ELSE
  greatest(2.0::DOUBLE * len(list_intersect(a.marked, b.marked)) / (len(a.marked) + len(b.marked)),
    CASE WHEN levenshtein(a.title, b.title) <= greatest(a.n, b.n) * 2 // 5 THEN 1.0::DOUBLE - levenshtein(a.title, b.title) / greatest(a.n, b.n)::DOUBLE ELSE 0.0::DOUBLE END) END AS sim FROM v a, v b),
pairs AS (SELECT q.id AS query, c.id AS candidate, sim, abs(q.year - c.year) AS gap, abs(q.runtime - c.runtime) / nullif(least(q.runtime, c.runtime)::DOUBLE, 0) AS off, c.popularity
  FROM p q JOIN p c ON q.id <> c.id JOIN like_ ON q_title = q.title AND c_title = c.title),
s AS (SELECT query, candidate, round((sim + 0.35::DOUBLE * CASE gap WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
  + 0.45::DOUBLE * coalesce(CASE WHEN off <= 0.02::DOUBLE THEN 1.0::DOUBLE WHEN off >= 0.25::DOUBLE THEN 0.0::DOUBLE ELSE (0.25::DOUBLE - off) / 0.23::DOUBLE END, 0.0::DOUBLE)
  + 0.05::DOUBLE * least(popularity / 100.0::DOUBLE, 1.0::DOUBLE)) / 1.85::DOUBLE, 6) AS score FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate)::INTEGER AS place FROM s WHERE score >= 0.45 QUALIFY place <= 5),
t AS (SELECT *, max(CASE WHEN place = 1 THEN score END) OVER q AS first, max(CASE WHEN place = 2 THEN score END) OVER q AS second FROM r WINDOW q AS (PARTITION BY query))
SELECT query, place, candidate, score, round(first - coalesce(second, 0.0::DOUBLE), 6) AS margin,
  CASE WHEN first >= 0.8 AND (second IS NULL OR round(first - coalesce(second, 0.0::DOUBLE), 6) > 0.08) THEN 'matched' ELSE 'ambiguous' END AS verdict FROM t""",
    "change_bursts": f"WITH {_EVENTS}, a AS (SELECT user_id AS key, tm, CASE WHEN tm - lag(tm) OVER w <= 3600000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY tm)), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY tm RANGE UNBOUNDED PRECEDING) AS run FROM a) SELECT key, min(tm) AS first_ms, max(tm) AS last_ms, count(*) AS n FROM b GROUP BY key, run",
}

ORACLES |= playback.ORACLES | ladders.ORACLES | recovery.ORACLES | {
    # a sliding log, attempt by attempt: the last admitted times of a key, the latest first
    "rate_limit": f"""WITH RECURSIVE {_EVENTS}, n AS (SELECT user_id AS key, tm AS at_ms, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) AS i FROM ev),
walk AS (SELECT key, at_ms, id, i, true AS admitted, at_ms AS one, NULL::BIGINT AS two FROM n WHERE i = 1
  UNION ALL SELECT n.key, n.at_ms, n.id, n.i, two IS NULL OR n.at_ms - two >= 86400000, CASE WHEN two IS NULL OR n.at_ms - two >= 86400000 THEN n.at_ms ELSE one END, CASE WHEN two IS NULL OR n.at_ms - two >= 86400000 THEN one ELSE two END FROM walk JOIN n ON n.key = walk.key AND n.i = walk.i + 1)
SELECT key, at_ms, id, admitted FROM walk""",
}
ORACLES |= {"quiet_bursts": live.BURSTS, "live_bursts": live.BURSTS, "live_rate_limit": ORACLES["rate_limit"]}
ORACLES |= tree.ORACLES
ORACLES |= index.ORACLES
ORACLES |= logs.ORACLES
ORACLES |= scan.ORACLES
