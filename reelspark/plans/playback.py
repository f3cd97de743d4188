"""Queries on tracks, sessions, playlists and integrity checks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import metadata, sessions, snapshot, tracks
from reelspark.sources import catalog
from reelspark.sources.catalog import ROWS_A_TASK, spread, table

NOW, DAY = 1_700_000_000, 86_400
WANTED = ["pt-pt", "fr", "en"]
TAGS = ["eng", "pt-BR", "fr_CA", "und", "JPN", "de", "por-PT", ""]


def _pick(values: list[str], at: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(at) % len(values) + 1).cast("int"))


def language_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag of each customer's orders to use."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("pos"), _pick(TAGS, "o_orderkey * 7 + o_custkey").alias("tag"))
    return tracks.resolve_language(rows, WANTED, "ja")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, idx, s, r, f, fidelity of the lines of orders; all lines of an order meet in one task of bounded rows before they are grouped, so no task holds the groups of a whole split."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    line = spread(rows, ROWS_A_TASK, "l_orderkey").groupBy(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("idx"))
    return line.agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("r"), F.min("l_linestatus").alias("f"), F.min("l_quantity").cast("long").alias("fidelity"))


def subtitle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9 on the lines of orders."""
    rows = _lines(spark, sf_dir).select("item", "idx", _pick(TAGS, "s + idx").alias("tag"), (F.col("r") == "R").alias("forced"), (F.col("f") == "F").alias("sdh"), "fidelity", (F.col("idx") % 3 == 0).alias("bitmap"))
    return tracks.rank_tracks(rows, WANTED, True, False)


def cue_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine readability rules on turns as cues."""
    return tracks.cue_issues(catalog.cues(spark, sf_dir))


def cue_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    return tracks.cue_quality(catalog.cues(spark, sf_dir), cue_issues(spark, sf_dir))


def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, J9, F14 on turns as generated cues; turns from the twelfth on have no evidence."""
    cues = catalog.cues(spark, sf_dir).select("track", "at", "text")
    known = F.when(F.col("at") % 4 != 0, ((F.col("track") * 7 + F.col("at") * 13) % 60 + 40) / 100.0)
    evidence = cues.filter("at < 12").select("track", "at", known.alias("confidence"), ((F.col("track") + F.col("at")) % 29 != 0).alias("has_speech"), (F.length("text") * 10 / (20 + (F.col("track") + F.col("at")) % 20)).cast("long").alias("source_chars"))
    return tracks.gate_generated(cues, evidence)


def rate_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans of orders, drifted by some known and unknown ratios."""
    span = F.lit(5_000_000) + F.col("o_orderkey") * 10
    drift = F.element_at(F.array(*(F.lit(x) for x in (1.0, 1.001, 0.96, 1.0427, 25 / 24, 1.25, 0.7, 2.0))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1000).cast("long").alias("first_cue"), (span + 1000).alias("last_cue"), F.lit(1500).cast("long").alias("first_speech"), (F.floor(span * drift) + 1500).alias("last_speech"))
    return tracks.rate_mismatch(rows).select("id", F.round("from_fps", 6).alias("from_fps"), F.round("to_fps", 6).alias("to_fps"))


def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 on events."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 6_000_000).alias("position_ms"), F.when(F.col("event_id") % 11 != 0, F.lit(5_400_000) - F.col("event_id") % 3 * 2_600_000).alias("duration_ms"))
    return sessions.resume_points(rows).select("event_id", "finished", "resume")


def segment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of so many half minutes."""
    return sessions.segment_timeline(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37.5).alias("seconds")), 60.0)


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, by priority."""
    outcome = F.when(F.col("o_orderstatus") == "F", "played").when(F.col("o_orderstatus") == "P", "failed").otherwise("not_reached")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", outcome.alias("outcome"), _pick(["no", "vaapi", "", "nvdec"], "o_orderkey").alias("hwdec"), _pick(["pq", "bt.1886", "hlg", "srgb", "linear"], "o_orderkey").alias("gamma"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 7 != 0).alias("seekable"), (F.col("o_orderkey") % 200).cast("double").alias("seconds"),
    )
    return sessions.session_report(rows, ["o_orderpriority"])


def _playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("p_brand"), F.lit("/"), "p_name", F.lit("/"), F.col("p_partkey").cast("string"))
    season = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select(path.alias("path"), _pick(["video", "audio", "subtitle", "image"], "p_partkey").alias("kind"), F.col("p_type").alias("title"), season.alias("season"), F.when(season.isNotNull() & (F.col("p_size") % 4 != 0), F.col("p_size")).alias("episode"), (F.col("p_partkey") % 2).alias("part"))


def playlist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.playlist_order(_playlist(spark, sf_dir))


def first_playables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.first_playables(_playlist(spark, sf_dir).select("path", "kind"), 300)


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 on parts as files."""
    rows = _playlist(spark, sf_dir).withColumn("year", F.when(F.col("part") == 1, F.lit(1970) + F.col("season"))).withColumn("episodes", F.when(F.col("episode").isNotNull(), F.array("episode", F.col("episode") + 70)))
    return sessions.labels(rows.withColumn("title", F.when(F.col("season") != 4, F.col("title")).otherwise("")))


def artwork_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pictures."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_partkey").alias("item"), _pick(["poster", "backdrop", "episode_still", "disc", "other"], "l_orderkey + l_linenumber").alias("kind"), F.concat_ws("-", F.lit("art"), "l_orderkey", "l_linenumber").alias("url"), _pick(TAGS, "l_suppkey + l_linenumber").alias("language"),
        (F.col("l_suppkey") % 5 * 400 + 400).alias("width"), (F.col("l_linenumber") * 300 - 300).cast("long").alias("height"), F.when(F.col("l_quantity") % 10 != 0, F.round(F.col("l_discount") * 100, 0)).alias("rating"), F.col("l_quantity").cast("long").alias("votes"), (F.col("l_linenumber") % 3).alias("provider_rank"),
    )
    return metadata.select_artwork(rows, WANTED)


def verify_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as an index with checks past, within 1 TiB."""
    files = catalog.files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    at = F.when(F.col("doc_id") % 3 != 0, F.lit(NOW) - F.col("doc_id") * 4000)
    index = files.select(
        "path", (F.col("size") * 4_194_304).alias("size"), (F.col("doc_id") % 17 == 0).alias("tombstoned"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pending"), at.alias("verified_at"),
        F.when(at.isNotNull(), F.when(F.col("doc_id") % 20 == 4, "stale").otherwise(F.col("sketch"))).alias("verified_digest"), F.when(F.col("quality") == 0, "odd").alias("needs_review"),
    )
    digests = files.select("path", F.when(F.col("doc_id") % 50 != 7, F.col("sketch")).alias("digest"))
    return snapshot.verify_pass(index, digests, NOW, 30 * DAY, 1 << 40)


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes counted."""
    return verify_pass(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


def snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yesterday's index against today's scan."""
    return snapshot.changed(*catalog.snapshots(spark, sf_dir))


QUERIES = {f.__name__: f for f in (language_choice, subtitle_rank, cue_issues, cue_quality, generation_gate, rate_mismatch, resume_points, segment_timeline, session_report, playlist_order, first_playables, file_labels, artwork_policy, verify_pass, verify_report, snapshot_changed)}

#: What the tags normalise to.
_NORMAL = "['en', 'pt-br', 'fr-ca', 'und', 'ja', 'de', 'pt-pt', 'und']"
_CUES = "cues AS (SELECT conv_id AS track, turn AS tm, turn * 4000 - CASE WHEN turn % 5 = 4 THEN 6000 ELSE 0 END AS start_ms, turn * 4000 - CASE WHEN turn % 5 = 4 THEN 6000 ELSE 0 END + 1500 + length(text) % 60 * 60 AS end_ms, text FROM conversations)"
_VISIBLE = r"replace(regexp_replace(regexp_replace({}, '\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*(?:\}}|$)', '', 'g'), '<[^>]*(?:>|$)', '', 'g'), '}}', '')"
_STEP = "CASE WHEN tag = 'pt-pt' THEN 0 WHEN split_part(tag, '-', 1) = 'pt' THEN 1 WHEN tag = 'fr' THEN 2 WHEN split_part(tag, '-', 1) = 'fr' THEN 3 WHEN tag = 'en' THEN 4 WHEN split_part(tag, '-', 1) = 'en' THEN 5"
_ISSUES = rf"""{_CUES}, c AS (SELECT *, length(regexp_replace({_VISIBLE.format('text')}, '\p{{Cc}}', '', 'g')) AS n, end_ms - start_ms AS ms, lag(start_ms) OVER w AS bs, lag(end_ms) OVER w AS be, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') AS lines FROM cues WINDOW w AS (PARTITION BY track ORDER BY tm)),
found AS (SELECT track, tm AS cue, unnest(CASE WHEN ms <= 0 OR n = 0 THEN ['malformed'] ELSE list_filter([
  CASE WHEN n * 1000.0 / ms > 17 THEN 'too_fast' END, CASE WHEN len(lines) > 2 THEN 'too_many_lines' END, CASE WHEN len(list_filter(lines, lambda x: length({_VISIBLE.format('x')}) > 42)) > 0 THEN 'line_too_long' END,
  CASE WHEN ms < 833 THEN 'too_short' END, CASE WHEN ms > 7000 THEN 'too_long' END,
  CASE WHEN start_ms < bs THEN 'out_of_order' WHEN start_ms < be THEN 'overlap' WHEN start_ms - be > 0 AND start_ms - be < 84 THEN 'gap_too_small' END], lambda x: x IS NOT NULL) END) AS issue FROM c)"""
_PLAYLIST = "f AS (SELECT p_brand || '/' || p_name || '/' || p_partkey AS path, ['video', 'audio', 'subtitle', 'image'][(p_partkey % 4 + 1)::INTEGER] AS kind, p_type AS title, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 END AS season, CASE WHEN p_size % 3 <> 0 AND p_size % 4 <> 0 THEN p_size END AS episode, p_partkey % 2 AS part FROM part)"
_VERIFY = f"""due AS (SELECT path, size, CASE WHEN pending THEN 0 WHEN seen_at IS NULL THEN 1 WHEN {NOW} - seen_at >= {30 * DAY} // CASE WHEN size >= 17179869184 THEN 4 WHEN size >= 8589934592 THEN 2 ELSE 1 END THEN CASE WHEN quality = 0 THEN 2 ELSE 3 END END::INTEGER AS tier, seen_at, old, digest FROM (
  SELECT source || '/' || lang || '/doc_' || doc_id AS path, n_chars * 4194304 AS size, coalesce(toxic = 1, false) AS pending, CASE WHEN doc_id % 3 <> 0 THEN {NOW} - doc_id * 4000 END AS seen_at, quality,
    CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 20 = 4 THEN 'stale' ELSE md5(text) END END AS old, CASE WHEN doc_id % 50 <> 7 THEN md5(text) END AS digest FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 17 <> 0)),
q AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN digest IS NULL THEN 0 ELSE size END) OVER w - CASE WHEN digest IS NULL THEN 0 ELSE size END + size AS need FROM due WHERE tier IS NOT NULL WINDOW w AS (ORDER BY tier, seen_at NULLS FIRST, path)),
v AS (SELECT path, tier, CASE WHEN n >= (SELECT coalesce(min(n), 1000000000000) FROM q WHERE n > 1 AND need > {1 << 40}) THEN 'skipped' WHEN digest IS NULL THEN 'read_failed' WHEN old IS NULL THEN 'baseline' WHEN old = digest THEN 'confirmed' ELSE 'mismatched' END AS outcome FROM q)"""

ORACLES: dict[str, str] = {
    "language_choice": f"WITH a AS (SELECT o_custkey AS item, o_orderkey AS pos, {_NORMAL}[((o_orderkey * 7 + o_custkey) % 8 + 1)::INTEGER] AS tag FROM orders), s AS (SELECT *, {_STEP} WHEN tag = 'ja' THEN 6 WHEN tag <> 'und' THEN 7 ELSE 8 END AS step FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY step, pos) AS n FROM s) SELECT item, pos, tag, CASE WHEN step = 0 THEN 'exact' WHEN step = 1 THEN 'dialect' WHEN step < 6 THEN 'fallback' WHEN step = 6 THEN 'original' ELSE 'last_resort' END AS match FROM r WHERE n = 1",
    "subtitle_rank": f"WITH g AS (SELECT l_orderkey AS item, l_partkey AS idx, min(l_suppkey) AS s, min(l_returnflag) AS r, min(l_linestatus) AS f, min(l_quantity)::BIGINT AS fidelity FROM lineitem GROUP BY 1, 2), t AS (SELECT *, {_NORMAL}[((s + idx) % 8 + 1)::INTEGER] AS tag FROM g), k AS (SELECT *, {_STEP} END AS step FROM t), c AS (SELECT item, idx, ((3 - step // 2) * 1000000 + CASE WHEN step % 2 = 0 THEN 200000 ELSE 100000 END + (r = 'R')::INTEGER * 50000 + (f <> 'F')::INTEGER * 20000 + fidelity * 100 + (idx % 3 <> 0)::INTEGER * 10)::BIGINT AS score FROM k WHERE step IS NOT NULL) SELECT item, row_number() OVER (PARTITION BY item ORDER BY score DESC, idx) AS place, idx, score FROM c",
    "cue_issues": f"WITH {_ISSUES} SELECT * FROM found",
    "cue_quality": f"WITH {_ISSUES}, b AS (SELECT track, count(DISTINCT cue) AS bad, bool_or(issue IN ('overlap', 'malformed', 'out_of_order')) AS blocking FROM found GROUP BY track), t AS (SELECT track, count(*) AS n_cues FROM cues GROUP BY track), r AS (SELECT track, n_cues, coalesce(bad, 0)::DOUBLE / n_cues AS rate, coalesce(blocking, false) AS blocking FROM t LEFT JOIN b USING (track)) SELECT track, n_cues, round(rate, 6) AS issue_rate, blocking, NOT blocking AND rate <= 0.10::DOUBLE AS acceptable FROM r",
    "generation_gate": rf"""WITH e AS (SELECT conv_id AS track, turn AS tm, coalesce(text, '') AS text, CASE WHEN turn < 12 AND turn % 4 <> 0 THEN ((conv_id * 7 + turn * 13) % 60 + 40) / 100.0::DOUBLE END AS confidence, turn < 12 AND (conv_id + turn) % 29 = 0 AS silent, CASE WHEN turn < 12 THEN length(text) * 10 // (20 + (conv_id + turn) % 20) END AS source FROM conversations),
p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM e), m AS (SELECT *, CASE WHEN plain = lag(plain) OVER w AND trim(text) <> '' THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY track ORDER BY tm)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY tm) AS run FROM m), u AS (SELECT *, count(*) OVER (PARTITION BY track, run) AS run_n, row_number() OVER (PARTITION BY track, run ORDER BY tm) AS run_i FROM r),
t AS (SELECT track, count(*) AS n_cues, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (silent AND trim(text) <> '') AS n_hallucinations, count(*) FILTER (confidence < 0.45::DOUBLE) AS n_low, count(*) FILTER (source > 0 AND length({_VISIBLE.format('text')})::DOUBLE / source > 3) AS n_runaway, count(*) FILTER (run_i = 1 AND run_n >= 4) AS n_loops FROM u GROUP BY track)
SELECT *, CASE WHEN n_loops > 0 OR coalesce(mean_confidence < 0.6::DOUBLE, false) OR n_hallucinations::DOUBLE / n_cues > 0.05::DOUBLE THEN 'reject' WHEN n_hallucinations + n_low + n_runaway = 0 THEN 'accept' ELSE 'draft' END AS verdict FROM t""",
    "rate_mismatch": "WITH rates(k, r) AS (VALUES (0, 24000 / 1001::DOUBLE), (1, 24::DOUBLE), (2, 25::DOUBLE), (3, 29.97::DOUBLE), (4, 30::DOUBLE), (5, 50::DOUBLE)), o AS (SELECT o_orderkey AS id, 5000000 + o_orderkey * 10 AS span, ([1.0::DOUBLE, 1.001::DOUBLE, 0.96::DOUBLE, 1.0427::DOUBLE, 25 / 24::DOUBLE, 1.25::DOUBLE, 0.7::DOUBLE, 2.0::DOUBLE])[(o_orderkey % 8 + 1)::INTEGER] AS drift FROM orders), s AS (SELECT id, floor(span * drift)::DOUBLE / span AS seen FROM o), p AS (SELECT id, a.r AS x, b.r AS y, abs(a.r / b.r - seen) / seen AS error, a.k AS i, b.k AS j FROM s, rates a, rates b WHERE a.k <> b.k AND abs(seen - 1) >= 0.002::DOUBLE), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY error, i, j) AS n FROM p WHERE error < 0.004::DOUBLE) SELECT o.id, round(x, 6) AS from_fps, round(y, 6) AS to_fps FROM o LEFT JOIN m ON m.id = o.id AND n = 1",
    "resume_points": "WITH e AS (SELECT event_id, event_id * 7919 % 6000000 AS p, CASE WHEN event_id % 11 <> 0 THEN 5400000 - event_id % 3 * 2600000 END AS d FROM events), f AS (SELECT *, coalesce(d > 0 AND (p >= d - 90000 OR p >= d * 0.97::DOUBLE), false) AS finished FROM e) SELECT event_id, finished, p >= 10000 AND NOT finished AS resume FROM f",
    "segment_timeline": "WITH f AS (SELECT p_partkey AS id, p_size * 37.5::DOUBLE AS seconds FROM part), s AS (SELECT id, seconds, unnest(generate_series(0, ceil(seconds / 60)::BIGINT - 1)) AS segment FROM f) SELECT id, segment, segment * 60.0::DOUBLE AS start_s, least((segment + 1) * 60.0::DOUBLE, seconds) - segment * 60.0::DOUBLE AS length_s FROM s",
    "session_report": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS played, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS not_reached, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 4 IN (0, 2)) AS software, count(*) FILTER (o_orderkey % 5 IN (0, 2)) AS hdr, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 6 <> 0 AND o_orderkey % 7 = 0 AND o_orderkey % 200 > 60) AS unseekable FROM orders GROUP BY 1",
    "playlist_order": f"WITH {_PLAYLIST} SELECT path, row_number() OVER (ORDER BY lower(title), coalesce(season, -1), coalesce(episode, -1), part, path) AS position FROM f WHERE kind IN ('video', 'audio')",
    "first_playables": f"WITH {_PLAYLIST}, r AS (SELECT path, kind, row_number() OVER (PARTITION BY kind IN ('video', 'audio') ORDER BY path) AS n FROM f) SELECT path, kind, (SELECT count(*) > 300 FROM f WHERE kind IN ('video', 'audio')) AS truncated FROM r WHERE n <= 300 OR kind NOT IN ('video', 'audio')",
    "file_labels": f"WITH {_PLAYLIST} SELECT path, CASE WHEN season IS NULL OR season = 4 THEN regexp_extract(path, '[^/]*$') ELSE title || CASE WHEN part = 1 THEN ' (' || (1970 + season) || ')' ELSE '' END || ' S' || lpad(season::VARCHAR, 2, '0') || CASE WHEN episode IS NULL THEN '' ELSE 'E' || lpad(episode::VARCHAR, 2, '0') || '-E' || (episode + 70) END END AS label FROM f",
    "artwork_policy": f"""WITH a AS (SELECT l_partkey AS item, ['poster', 'backdrop', 'episode_still', 'disc', 'other'][((l_orderkey + l_linenumber) % 5 + 1)::INTEGER] AS kind, 'art-' || l_orderkey || '-' || l_linenumber AS url, {_NORMAL}[((l_suppkey + l_linenumber) % 8 + 1)::INTEGER] AS tag, l_suppkey % 5 * 400 + 400 AS width, l_linenumber * 300 - 300 AS height, CASE WHEN l_quantity % 10 <> 0 THEN round(l_discount * 100, 0) END AS rating, l_quantity::BIGINT AS votes, l_linenumber % 3 AS p FROM lineitem),
k(kind, policy, ideal, off, least_width) AS (VALUES ('poster', 'user', 0.667::DOUBLE, 0.08::DOUBLE, 500), ('backdrop', 'textless', 1.778::DOUBLE, 0.15::DOUBLE, 1280), ('episode_still', 'any', 1.778::DOUBLE, 0.15::DOUBLE, 640), ('disc', 'textless', 1.0::DOUBLE, 0.05::DOUBLE, 400)),
b AS (SELECT a.*, policy, least_width, abs(CASE WHEN height = 0 THEN 0 ELSE width::DOUBLE / height END - ideal) <= off AS ok, {_STEP} WHEN tag = 'und' THEN 6 ELSE 7 END AS step FROM a JOIN k USING (kind)),
r AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY NOT (ok AND width >= least_width), CASE policy WHEN 'any' THEN 0 WHEN 'textless' THEN (tag <> 'und')::INTEGER ELSE step END, CASE WHEN policy = 'user' AND step < 6 THEN tag ELSE '' END, p, floor((coalesce(rating, 5.0) * votes + 50.0) / (votes + 10) * 1000)::BIGINT DESC, width DESC, url) AS n FROM b)
SELECT item, kind, url, tag = 'und' AS textless, ok AS aspect_ok FROM r WHERE n = 1""",
    "verify_pass": f"WITH {_VERIFY} SELECT path, tier, outcome FROM v",
    "verify_report": f"WITH {_VERIFY} SELECT outcome, count(*) AS n FROM v GROUP BY outcome",
    "snapshot_changed": "WITH f AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id AS path, n_chars AS size, md5(text) AS sketch FROM documents), a AS (SELECT path, size, sketch FROM f WHERE doc_id % 7 <> 0), b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, sketch FROM f WHERE doc_id % 13 <> 0) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) > 0 AS changed",
}
