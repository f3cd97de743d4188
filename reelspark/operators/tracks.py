"""Subtitle tracks: language choice, ranking, readability issues, the gate for generated cues, frame-rate mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import language
from reelspark.operators.ranges import lagged

# Fixed values of the gate: least confidence of a cue and of a track, cues of a loop, longest text against its source, share of hallucinations.
CUE_FLOOR, TRACK_FLOOR, LOOP, RUNAWAY, HALLUCINATIONS = 0.45, 0.60, 4, 3.0, 0.05
# Known frame rates.
RATES = (24000 / 1001, 24.0, 25.0, 29.97, 30.0, 50.0)


def resolve_language(available: DataFrame, wanted: list[str], original: str | None = None) -> DataFrame:
    """Of each item's tags (item, pos, tag) the one to use: exact before dialect along the wanted chain, the original language, the first that names one.

    A least struct, so tags combine before the shuffle. Returns item, pos, tag (normalised), match.
    """
    rows = available.withColumn("tag", language.tag(F.col("tag")))
    best = rows.groupBy("item").agg(F.min(F.struct(language.step(F.col("tag"), wanted, original).alias("step"), "pos", "tag")).alias("x"))
    return best.select("item", "x.pos", "x.tag", language.match_name(F.col("x.step"), len(wanted)).alias("match"))


def rank_tracks(tracks: DataFrame, wanted: list[str], audio_understood: bool, prefer_sdh: bool, keep: list[str] | None = None) -> DataFrame:
    """Usable tracks of each item by score, then by index: tracks in a wanted language, forced ones only if the audio is understood.

    tracks: item, idx, tag, forced, sdh, fidelity (0 to 100), bitmap. Returns item, place, idx, score, and the columns to keep.
    """
    own = language.tag(F.col("tag"))
    exact, dialect = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, w in reversed(list(enumerate(wanted))):
        exact = F.when((own == w) & (own != "und"), k).otherwise(exact)
        dialect = F.when((own != "und") & (language.base(own) == w.split("-")[0]), k).otherwise(dialect)
    pos = F.coalesce(exact, dialect)
    usable = pos.isNotNull() & (~F.col("forced") | F.lit(audio_understood))

    def one(c: Column) -> Column:
        return c.cast("long")

    score = (F.lit(len(wanted)) - pos) * 1_000_000 + F.when(exact.isNotNull(), 2).otherwise(1) * 100_000 + one(F.col("forced") == audio_understood) * 50_000 + one(F.col("sdh") == prefer_sdh) * 20_000 + F.col("fidelity") * 100 + one(~F.col("bitmap")) * 10
    rows = tracks.filter(usable).select("item", "idx", score.cast("long").alias("score"), *(keep or []))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "idx"))).select("item", "place", "idx", "score", *(keep or []))


def visible(text: Column) -> Column:
    """text without <tags> and {blocks} (nested up to three deep; what is not closed goes to the end)."""
    text = F.regexp_replace(text, r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*(?:\}|$)", "")
    return F.replace(F.regexp_replace(text, "<[^>]*(?:>|$)", ""), F.lit("}"), F.lit(""))


def plain(text: Column) -> Column:
    """letters, digits and single spaces, lower-cased; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def cue_issues(cues: DataFrame, max_cps: float = 17.0, line_chars: int = 42, max_lines: int = 2, least_ms: int = 833, most_ms: int = 7000, gap_ms: int = 84) -> DataFrame:
    """Per-cue readability rules: a row for each issue of a cue (track, at, start_ms, end_ms, text): track, cue, issue.

    A cue without visible text or time is malformed and has no other issue. A null text is empty.
    """
    rows = lagged(cues.select("track", "at", "start_ms", "end_ms", "text"), "track", ["at"], ["start_ms", "end_ms"])
    rows = rows.withColumnsRenamed({"before_start_ms": "before_start", "before_end_ms": "before_end"}).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n", F.length(F.regexp_replace(visible(F.col("text")), r"\p{Cc}", ""))).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    gap = F.col("start_ms") - F.col("before_end")
    rules = [
        F.when(F.col("n") * 1000.0 / F.col("ms") > max_cps, "too_fast"),
        F.when(F.size(lines) > max_lines, "too_many_lines"),
        F.when(F.exists(lines, lambda x: F.length(visible(x)) > line_chars), "line_too_long"),
        F.when(F.col("ms") < least_ms, "too_short"),
        F.when(F.col("ms") > most_ms, "too_long"),
        F.when(F.col("start_ms") < F.col("before_start"), "out_of_order").when(gap < 0, "overlap").when((gap > 0) & (gap < gap_ms), "gap_too_small"),
    ]
    found = F.when((F.col("ms") <= 0) | (F.col("n") == 0), F.array(F.lit("malformed"))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return rows.select("track", F.col("at").alias("cue"), F.explode(found).alias("issue"))


def cue_quality(cues: DataFrame, issues: DataFrame) -> DataFrame:
    """Of each track the cues, the share of them with issues, whether one blocks, and whether the track is acceptable as it is."""
    own = issues.groupBy("track", "cue").agg(F.bool_or(F.col("issue").isin("overlap", "malformed", "out_of_order")).alias("blocks"))
    own = own.groupBy("track").agg(F.count("*").alias("bad"), F.bool_or("blocks").alias("blocking"))
    rows = cues.groupBy("track").agg(F.count("*").alias("n_cues")).join(own, "track", "left")
    rate, blocking = F.coalesce("bad", F.lit(0)) / F.col("n_cues"), F.coalesce("blocking", F.lit(False))
    return rows.select("track", "n_cues", F.round(rate, 6).alias("issue_rate"), blocking.alias("blocking"), (~blocking & (rate <= 0.10)).alias("acceptable"))


def gate_generated(cues: DataFrame, evidence: DataFrame, mismatched: Column | None = None) -> DataFrame:
    """Whether the generated cues of a track are fit to attach: accept, draft or reject.

    cues: track, at, text; evidence: track, at, confidence, has_speech, source_chars, each null or missing where unknown. mismatched: whether the
    detected language of a track (of cues) is not its tag's. Loops are four or more cues in a row with equal plain text, the first of which may be
    blank, as the reference's rule has it. Returns track, n_cues, mean_confidence, n_hallucinations, n_low, n_runaway, n_loops, verdict.
    """
    w = Window.partitionBy("track").orderBy("at")
    rows = cues.withColumn("mismatched", mismatched if mismatched is not None else F.lit(False)).join(evidence, ["track", "at"], "left")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("plain", plain(F.col("text")))
    same = (F.col("plain") == F.lag("plain").over(w)) & (F.trim("text") != "")
    rows = rows.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    silent = ~F.col("has_speech") & (F.trim("text") != "")
    runaway = (F.col("source_chars") > 0) & (F.length(visible(F.col("text"))) / F.col("source_chars") > RUNAWAY)
    runs = rows.groupBy("track", "run").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("sum"), F.count("confidence").alias("known"), F.count_if(silent).alias("silent"),
        F.count_if(F.col("confidence") < CUE_FLOOR).alias("low"), F.count_if(runaway).alias("runaway"), F.bool_or("mismatched").alias("mismatched"),
    )
    out = runs.groupBy("track").agg(
        F.sum("n").alias("n_cues"), F.round(F.sum("sum") / F.sum("known"), 6).alias("mean_confidence"), F.sum("silent").alias("n_hallucinations"), F.sum("low").alias("n_low"),
        F.sum("runaway").alias("n_runaway"), F.count_if(F.col("n") >= LOOP).alias("n_loops"), F.bool_or("mismatched").alias("mismatched"),
    )
    weak = F.coalesce(F.col("mean_confidence") < TRACK_FLOOR, F.lit(False))
    reject = (F.col("n_loops") > 0) | weak | (F.col("n_hallucinations") / F.col("n_cues") > HALLUCINATIONS)
    clean = (F.col("n_hallucinations") + F.col("n_low") + F.col("n_runaway") == 0) & ~F.col("mismatched")
    return out.withColumn("verdict", F.when(reject, "reject").when(clean, "accept").otherwise("draft")).drop("mismatched")


def rate_mismatch(spans: DataFrame) -> DataFrame:
    """the pair of known frame rates whose ratio explains how far speech drifts from cues: the nearest within 0.4 %, none within 0.2 % of 1.

    spans: id, first_cue, last_cue, first_speech, last_speech (ms). Returns id, from_fps, to_fps, null where there is none.
    """
    cue, speech = (F.col("last_cue") - F.col("first_cue")).cast("double"), (F.col("last_speech") - F.col("first_speech")).cast("double")
    observed = F.when((cue > 0) & (speech > 0) & (F.col("first_cue") >= 0) & (F.abs(speech / cue - 1.0) >= 0.002), speech / cue)
    pairs = [(a, b) for a in RATES for b in RATES if a != b]
    fits = F.array(*(F.struct((F.abs(F.lit(a / b) - F.col("o")) / F.col("o")).alias("error"), F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(pairs)))
    best = F.array_min(F.filter(fits, lambda x: x["error"] < 0.004))
    return spans.withColumn("o", observed).withColumn("best", best).select("id", F.col("best.a").alias("from_fps"), F.col("best.b").alias("to_fps"))
