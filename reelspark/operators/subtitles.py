"""Quality of subtitle cues and timing against speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.ranges import at_share, lagged


def cue_checks(cues: DataFrame, gap_ms: int = 80) -> DataFrame:
    """What is wrong between a cue and the one before it: out of order, else overlap, else too small a gap. A long track spans ranges."""
    rows = lagged(cues.select("track", "at", "start_ms", "end_ms"), "track", ["at"], ["start_ms", "end_ms"]).withColumnsRenamed({"before_start_ms": "before_start", "before_end_ms": "before_end"})
    issue = F.when(F.col("start_ms") < F.col("before_start"), "out_of_order").when(F.col("start_ms") < F.col("before_end"), "overlap").when(F.col("start_ms") - F.col("before_end") < gap_ms, "gap")
    return rows.select("track", F.col("at").alias("cue"), issue.alias("issue")).filter("issue IS NOT NULL")


def readability(cues: DataFrame, most_cps: float = 17.0) -> DataFrame:
    """Characters a second of each track: mean, 95th by floored index, share of cues above the limit."""
    cps = F.round(F.length(F.regexp_replace("text", "<[^>]*>", "")) * 1000.0 / (F.col("end_ms") - F.col("start_ms")), 6)
    rows = cues.filter("end_ms > start_ms").select("track", cps.alias("cps"))
    p95 = at_share(rows, "track", "cps", "p95_cps", 95, 100).withColumnRenamed("track", "track_")
    sums = rows.groupBy("track").agg(F.round(F.avg("cps"), 4).alias("mean_cps"), F.round(F.avg((F.col("cps") > most_cps).cast("double")), 4).alias("issue_rate"))
    return sums.join(p95, F.col("track").eqNullSafe(F.col("track_"))).select("track", "mean_cps", "p95_cps", "issue_rate")


def repetition_loops(events: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many equal values in order (track, at, id, value): track, first, n, value. Null and blank values form no runs."""
    w = Window.partitionBy("track").orderBy("at", "id")
    same = (F.col("value") == F.lag("value").over(w)) & (F.trim("value") != "")
    rows = events.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("track", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min("value").alias("value"))
    return runs.filter(F.col("n") >= least).select("track", "first", "n", "value")


def nearest(cue_starts: DataFrame, speech_starts: DataFrame, window_ms: int) -> DataFrame:
    """For each cue the nearest speech onset of its track (the earlier on a tie) within the window, and the 50 ms bucket of the
    offset. Both sides are merged in time and carried forward and backward; no pairs are made.
    """
    merged = cue_starts.select("track", "at", "id", F.lit(None).cast("long").alias("speech")).unionByName(speech_starts.select("track", "at", F.lit(None).cast("long").alias("id"), F.col("at").alias("speech")))
    w = Window.partitionBy("track").orderBy("at")
    before = F.last("speech", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("speech", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    rows = merged.withColumn("before", before).withColumn("after", after).filter("id IS NOT NULL")
    back, ahead = F.col("at") - F.col("before"), F.col("after") - F.col("at")
    offset = F.when(F.col("after").isNull() | (back <= ahead), -back).otherwise(ahead)
    return rows.select("id", offset.alias("offset_ms")).filter(F.abs("offset_ms") <= window_ms).withColumn("bucket", F.floor(F.col("offset_ms") / 50))


def estimate_offsets(cue_starts: DataFrame, speech_starts: DataFrame, window_ms: int = 600_000, bucket_ms: int = 50) -> DataFrame:
    """The constant offset of each track (track, at on both sides): the median, by floored index, of the fullest bucket of all differences
    within the window. Of equally full buckets the one nearest to 0 stands, then the later.

    All pairs count, also where the reference samples (above 4,000,000 a track). Equal times are joined once and differences are counted, so
    a track leaves at most one row for each millisecond of the window. Returns track, offset_ms, n_pairs (those of the bucket).
    """
    slot = F.floor(F.col("at") / window_ms)
    cues = cue_starts.filter("at IS NOT NULL").groupBy("track", F.col("at").alias("cue")).agg(F.count("*").alias("n_cues"))
    cues = cues.withColumn("slot", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.floor(F.col("cue") / window_ms) + k)))
    speech = speech_starts.filter("at IS NOT NULL").groupBy("track", "at").agg(F.count("*").alias("n_speech")).withColumn("slot", slot)
    pairs = cues.join(speech, ["track", "slot"]).withColumn("diff", F.col("at") - F.col("cue")).filter(F.abs("diff") <= window_ms)
    counts = pairs.groupBy("track", "diff").agg(F.sum(F.col("n_cues") * F.col("n_speech")).alias("n")).withColumn("bucket", F.floor(F.col("diff") / bucket_ms))
    buckets = counts.groupBy("track", "bucket").agg(F.sum("n").alias("n_pairs"), F.array_sort(F.collect_list(F.struct("diff", "n"))).alias("diffs"))
    best = buckets.groupBy("track").agg(F.max(F.struct("n_pairs", (-F.abs("bucket")).alias("near"), "bucket", "diffs")).alias("x")).select("track", "x.n_pairs", "x.diffs")
    # the first difference up to which more than half of the bucket's pairs, rounded down, lie
    upto = F.transform("diffs", lambda d: F.struct(d["diff"].alias("diff"), F.aggregate(F.filter("diffs", lambda e: e["diff"] <= d["diff"]), F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("upto")))
    median = F.filter(upto, lambda d: d["upto"] > F.floor(F.col("n_pairs") / 2))[0]["diff"]
    return best.select("track", median.alias("offset_ms"), "n_pairs")


#: What ends a clause (fixed values of F13).
CLAUSE_ENDS = (",", ".", "!", "?", ";", ":", "—")


def wrapped(text: Column, width: int = 42, most_lines: int = 2) -> Column:
    """a cue's text in lines of at most ``width`` characters, about equally long, broken at a clause's end where a line has reached its share.

    White space of any kind is one blank. A text that fits is one line; a longer word has a line of its own; lines after the last allowed one are cut off. A null text is null. The fold
    over the words keeps the lines done and the one begun, so a long text costs its length once.
    """

    def fold(words: Column) -> Column:
        flat = F.array_join(words, " ")
        total = F.char_length(flat)
        target = F.ceil(total / F.greatest(F.ceil(total / F.lit(width)), F.lit(1)))
        start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

        def add(state: Column, word: Column) -> Column:
            line, lines = state["line"], state["lines"]
            longer = F.char_length(line) + 1 + F.char_length(word) > width
            clause = (F.char_length(line) >= target) & F.right(line, F.lit(1)).isin(*CLAUSE_ENDS)
            full = F.size(lines) >= most_lines  # nothing more is kept
            breaks = (line != "") & (longer | clause)
            return F.when(full, state).when(breaks, F.struct(F.concat(lines, F.array(line)).alias("lines"), word.alias("line"))).otherwise(
                F.struct(lines.alias("lines"), F.when(line == "", word).otherwise(F.concat(line, F.lit(" "), word)).alias("line"))
            )

        def finish(state: Column) -> Column:
            return F.array_join(F.slice(F.when(state["line"] == "", state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"]))), 1, most_lines), "\n")

        return F.when(total <= width, flat).otherwise(F.aggregate(words, start, add, finish))

    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.get(F.transform(F.array(words), fold), F.lit(0))
