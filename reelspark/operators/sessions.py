"""Playback sessions and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import ascii_lower
from reelspark.operators.ranges import numbered

# Fixed values of the resume rule: least position, margin at the end, and share that counts as watched.
LEAST_MS, MARGIN_MS, WATCHED = 10_000, 90_000, 0.97
MOST_SEGMENTS = 1_000_000


def resume_points(rows: DataFrame) -> DataFrame:
    """Whether a position is the end of its file, and whether to go on from it. Adds finished, resume to rows with position_ms, duration_ms; an unknown duration (null or up to 0) has no end."""
    position, duration = F.col("position_ms"), F.col("duration_ms")
    finished = F.coalesce((duration > 0) & ((position >= duration - MARGIN_MS) | (position >= duration * WATCHED)), F.lit(False))
    return rows.withColumn("finished", finished).withColumn("resume", F.coalesce(position >= LEAST_MS, F.lit(False)) & ~finished)


def segment_timeline(rows: DataFrame, target: float) -> DataFrame:
    """The segments of each file (id, seconds): id, segment, start_s, length_s; the last is shorter. None for no time or more than a million."""
    count = F.ceil(F.col("seconds") / target)
    some = rows.filter((F.col("seconds") > 0) & (F.col("seconds") < float("inf")) & (F.col("seconds") / target <= MOST_SEGMENTS))
    some = some.select("id", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("segment"))
    start = F.col("segment") * target
    return some.select("id", "segment", start.alias("start_s"), (F.least((F.col("segment") + 1) * target, F.col("seconds")) - start).alias("length_s"))


def session_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts of played, failed and not reached files, and of played ones decoded in software, in HDR and without seeking (over a minute).

    results: the columns of by, outcome (played, failed, not_reached), hwdec, gamma, seekable, seconds.
    """
    played = F.col("outcome") == "played"
    return results.groupBy(*by).agg(
        F.count_if(played).alias("played"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "not_reached").alias("not_reached"),
        F.count_if(played & F.col("hwdec").isin("no", "")).alias("software"), F.count_if(F.col("gamma").isin("pq", "hlg")).alias("hdr"), F.count_if(played & ~F.col("seekable") & (F.col("seconds") > 60)).alias("unseekable"),
    )


def playlist_order(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """Videos and audio by title (A-Z lower-cased), season, episode, part and path. files: path, kind, title, season, episode, part.

    A season without an episode goes before its episodes, a title without either before all seasons. Numbered range by range. Returns path, position.
    """
    keyed = files.filter(F.col("kind").isin("video", "audio")).select(
        ascii_lower(F.col("title")).alias("t"), F.coalesce("season", F.lit(-1)).cast("long").alias("s"), F.coalesce("episode", F.lit(-1)).cast("long").alias("e"), F.coalesce("part", F.lit(0)).cast("long").alias("p"), "path",
    )
    return numbered(keyed, ["t", "s", "e", "p", "path"], "position", ranges).select("path", "position")


def first_playables(files: DataFrame, limit: int, ranges: int | None = None) -> DataFrame:
    """O2: the first ``limit`` videos and audios by path, and all other files; truncated tells whether any went. files: path, kind."""
    playable = F.col("kind").isin("video", "audio")
    rows = numbered(files.filter(playable).select("path", "kind"), ["path"], "n", ranges)
    kept = rows.filter(F.col("n") <= limit).drop("n").unionByName(files.filter(~F.coalesce(playable, F.lit(False))).select("path", "kind"))
    return kept.crossJoin(F.broadcast(files.agg((F.count_if(playable) > limit).alias("truncated"))))


def labels(files: DataFrame) -> DataFrame:
    """path, label: title, year and episodes ("Title (2017) S01E01-E02"); the file's name if there is no title. files: path, title, year, season, episodes (array of int)."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    wide = lambda c: F.when(c < 100, two(c)).otherwise(c.cast("string"))
    episodes = F.array_join(F.transform(F.coalesce("episodes", F.array().cast("array<int>")), lambda e: F.concat(F.lit("E"), wide(e))), "-")
    label = F.concat("title", F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" S"), wide(F.col("season")), episodes), F.lit("")))
    return files.select("path", F.when(F.coalesce("title", F.lit("")) == "", F.substring_index("path", "/", -1)).otherwise(label).alias("label"))
