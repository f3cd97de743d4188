"""Plans and verdicts over several rows: recovery rungs, subtitle acquisition, paired runs, stable ids, folder context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import language
from reelspark.operators import library, tracks

# The rungs in order, and which of them may lose content.
RUNGS = ["normal", "escalated_probe", "tolerant_flags", "forced_demuxer", "index_reconstruction", "raw_elementary_stream", "parameter_inference", "error_concealment", "decoder_escalation", "stream_isolation", "repair_transcode"]
LOSSY = ["index_reconstruction", "raw_elementary_stream", "error_concealment", "stream_isolation", "repair_transcode"]
# Failures and the first rung that can help; none for those that end the attempt.
FIRST_RUNG = {
    "container_unrecognised": 3, "no_streams_found": 1, "codec_parameters_missing": 6, "index_unusable_or_missing": 2, "structure_corrupt": 2, "timestamps_unusable": 2, "truncated": 2,
    "decode_error": 7, "hardware_decoder_failed": 8, "track_unrecoverable": 9, "drm_protected": None, "no_decoder_exists": None, "no_decodable_data": None, "hardware_insufficient": None,
}
LAST = len(RUNGS) - 1
#: Requests whose steps a task puts in order.
REQUESTS_A_TASK = 100_000


def recovery(failures: DataFrame) -> DataFrame:
    """Where the attempts to open each item stand after its failures (item, at, id, failure), in order of at, id.

    A failure moves on to its first useful rung, or by one if that lies behind. So the rung after k failures is k + max(0, the greatest
    first rung - j among failures j <= k): a running maximum. Each failure climbs at least one rung, so no more than eleven of an item matter,
    and the rest leave before the shuffle. Returns item, n_failures (up to the end), rung, outcome (open, terminal, exhausted), cause (of
    a terminal end), degraded, content_loss. Failures that are null or unknown are ignored; an item without failures has no row.
    """
    first = F.create_map(*(F.lit(x) for name, rung in FIRST_RUNG.items() for x in (name, -1 if rung is None else rung)))
    known = failures.select("item", "at", "id", "failure", F.try_element_at(first, "failure").alias("first")).filter("first IS NOT NULL")
    in_order = Window.partitionBy("item").orderBy("at", "id")
    steps = known.withColumn("k", F.row_number().over(in_order)).filter(F.col("k") <= LAST + 1)
    so_far = Window.partitionBy("item").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rung = F.col("k") + F.greatest(F.lit(0), F.max(F.col("first") - F.col("k")).over(so_far))
    terminal = F.col("first") < 0
    steps = steps.withColumn("rung", rung).withColumn("ends", F.when(terminal, "terminal").when(F.col("rung") > LAST, "exhausted"))
    end = F.min(F.when(F.col("ends").isNotNull(), F.struct("k", F.col("ends").alias("outcome"), F.when(terminal, F.col("failure")).alias("cause"))))
    steps = steps.withColumn("end", end.over(Window.partitionBy("item")))
    open_ = F.coalesce(F.col("k") < F.col("end.k"), F.lit(True))
    lossy = F.array(*(F.lit(RUNGS.index(r)) for r in LOSSY))
    found = steps.groupBy("item").agg(
        F.coalesce(F.first("end.k"), F.count("*")).cast("long").alias("n_failures"),
        F.coalesce(F.max(F.when(open_, F.col("rung"))), F.lit(0)).alias("level"),
        F.coalesce(F.first("end.outcome"), F.lit("open")).alias("outcome"),
        F.first("end.cause").alias("cause"),
        F.coalesce(F.max(open_ & F.array_contains(lossy, F.col("rung"))), F.lit(False)).alias("content_loss"),
    )
    name = F.element_at(F.array(*(F.lit(r) for r in RUNGS)), (F.col("level") + 1).cast("int"))
    return found.select("item", "n_failures", name.alias("rung"), "outcome", "cause", (F.col("level") > 2).alias("degraded"), "content_loss")


def acquisition_plan(available: DataFrame, requests: DataFrame, wanted: list[str], audio_understood: bool, prefer_sdh: bool, ocr: bool = True, generate: bool = True) -> DataFrame:
    """The steps, in order, to get subtitles for each request, until one gives some.

    available: item, idx, tag, forced, sdh, fidelity (0 to 100), bitmap, machine; requests: item (once each), captions, audio_tag. Returns item,
    place, step, idx (of the track used, else null), tag (the language of the step). Usable tracks come first, best first; then
    searches in each wanted language, exactly and then in its dialects; captions in the picture; translation of human text in other languages; speech.
    """
    target = wanted[0] if wanted else "en"
    asked = available.join(requests.select("item"), "item", "left_semi").withColumn("tag", language.tag(F.col("tag")))
    none = F.lit(None).cast(available.schema["idx"].dataType)

    def step(rows: DataFrame, rung: int, key: Column, name: Column, idx: Column, tag: Column) -> DataFrame:
        return rows.select("item", F.lit(rung).alias("group_"), key.cast("long").alias("key_"), name.alias("step"), idx.alias("idx"), tag.alias("tag"))

    usable = tracks.rank_tracks(asked.filter(~F.col("bitmap") | F.lit(ocr)), wanted, audio_understood, prefer_sdh, keep=["bitmap", "tag"])
    plan = step(usable, 0, F.col("place"), F.when(F.col("bitmap"), "ocr_bitmap").otherwise("use_existing"), F.col("idx"), F.col("tag"))
    if wanted:
        each = F.posexplode(F.array(*(F.lit(w) for w in wanted))).alias("pos", "want")
        searches = requests.select("item", each)
        for rung, name in ((1, "search_exact"), (2, "search_dialect")):
            plan = plan.unionByName(step(searches, rung, F.col("pos"), F.lit(name), none, F.col("want")))
    plan = plan.unionByName(step(requests.filter("captions"), 3, F.lit(0), F.lit("extract_captions"), none, F.lit(None).cast("string")))
    if generate:
        human = asked.filter(~F.col("bitmap") & ~F.col("forced") & ~F.col("machine") & (F.col("tag") != "und") & (language.base(F.col("tag")) != target.split("-")[0]))
        plan = plan.unionByName(step(human, 4, -F.col("fidelity"), F.lit("translate"), F.col("idx"), F.col("tag")))
        plan = plan.unionByName(step(requests, 5, F.lit(0), F.lit("transcribe"), none, language.tag(F.col("audio_tag"))))
    elif not wanted:
        plan = plan.unionByName(step(requests, 9, F.lit(0), F.lit("unavailable"), none, F.lit(None).cast("string")))
    n = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), requests.count() // REQUESTS_A_TASK + 1)
    plan = plan.repartition(n, "item").withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("group_", "key_", "idx")).cast("long"))
    return plan.filter("group_ < 9 OR place = 1").select("item", "place", "step", "idx", "tag")


def paired_verdicts(stages: DataFrame, baseline_delayed: float, added_delayed: float, fps_ratio: float, avsync_ms: float, added_cpu: float | None = None, osd_ms: float | None = None) -> DataFrame:
    """What a run with a composited stage lost against its baseline.

    stages: run, stage (baseline, composited), n_samples, delayed_per_min, mean_fps, max_avsync_ms, mean_cpu, osd_ms (the last of the composited stage).
    Both rows of a run meet in one aggregate. Returns run, outcome (pass, pass_with_notes, fail, inconclusive), added_delayed, ratio, added_cpu,
    findings (in order). A stage that is missing or without samples, or a baseline that is late itself, proves nothing. Rates are rounded to six places.
    """
    value = F.struct("n_samples", "delayed_per_min", "mean_fps", "max_avsync_ms", "mean_cpu", "osd_ms")
    runs = stages.groupBy("run").agg(*(F.max(F.when(F.col("stage") == s, value)).alias(s) for s in ("baseline", "composited")))

    def of(stage: str, name: str) -> Column:
        return F.coalesce(F.col(f"{stage}.{name}"), F.lit(0.0))

    late = F.round(of("composited", "delayed_per_min") - of("baseline", "delayed_per_min"), 6)
    ratio = F.when(of("baseline", "mean_fps") > 0, F.round(of("composited", "mean_fps") / of("baseline", "mean_fps"), 6)).otherwise(0.0)
    runs = runs.withColumn("added_delayed", late).withColumn("ratio", ratio).withColumn("added_cpu", F.round(F.col("composited.mean_cpu") - F.col("baseline.mean_cpu"), 6))
    unusable = F.when((of("baseline", "n_samples") == 0) | (of("composited", "n_samples") == 0), "no_samples").when(of("baseline", "delayed_per_min") > baseline_delayed, "baseline_late")
    osd = F.col("composited.osd_ms")
    checks = [
        F.when(F.col("added_delayed") > added_delayed, "late_presents").otherwise("late_presents_within_budget"),
        F.when(F.col("ratio") < fps_ratio, "frame_rate"),
        F.when(of("composited", "max_avsync_ms") > avsync_ms, "desync"),
        F.when(F.col("added_cpu") > added_cpu, "cpu") if added_cpu is not None else F.lit(None),
        F.when(osd.isNull(), "osd_not_measured").when(osd > osd_ms, "osd_slow").otherwise("osd_in_time") if osd_ms is not None else F.lit(None),
    ]
    findings = F.when(unusable.isNotNull(), F.array(unusable)).otherwise(F.array_compact(F.array(*checks)))
    runs = runs.withColumn("findings", findings)

    def any_of(*names: str) -> Column:
        return F.arrays_overlap("findings", F.array(*(F.lit(n) for n in names)))

    outcome = F.when(unusable.isNotNull(), "inconclusive").when(any_of("late_presents", "frame_rate", "desync", "osd_slow"), "fail").when(any_of("cpu", "osd_not_measured"), "pass_with_notes").otherwise("pass")
    return runs.select("run", outcome.alias("outcome"), "added_delayed", "ratio", "added_cpu", "findings")


def stable_ids(previous: DataFrame, paths: DataFrame, next_id: int) -> DataFrame:
    """Ids of a scan's paths (path, once each): those of before (path, id) are kept, fresh ones count on from next_id along the order of paths.

    Ids of paths that are gone are never given again, as next_id only grows. Paths must not be null.
    """
    kept = paths.select("path").join(previous.select("path", "id"), "path")
    fresh = library.name_order(paths.select("path").join(previous.select("path"), "path", "left_anti"))
    return kept.select("path", "id", F.lit(False).alias("fresh")).unionByName(fresh.select("path", (F.col("position") + (next_id - 1)).alias("id"), F.lit(True).alias("fresh")))


def merge_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """What a file's name says, with what its folder's name says.

    files: path, folder, title, year, ids (array), kind (season_episode, season_only, absolute, date or null), season, numbers (array<long>),
    editions (array of ordinals); folders: folder (once each), the same columns. The folder's title wins unless empty or shorter in bytes, its year if it
    has one; ids are added; a season of the folder makes absolute numbers its episodes; a file without an episode takes the folder's. Without a folder all stays.
    """
    ours, theirs = (lambda n: F.col(f"f.{n}")), (lambda n: F.col(f"d.{n}"))
    rows = files.alias("f").join(folders.alias("d"), ours("folder") == theirs("folder"), "left")
    title = F.when((theirs("title") != "") & (F.octet_length(theirs("title")) >= F.octet_length(F.coalesce(ours("title"), F.lit("")))), theirs("title")).otherwise(ours("title"))
    none = F.coalesce(theirs("ids"), F.array().cast("array<string>"))
    own = F.coalesce(ours("ids"), F.array().cast("array<string>"))
    seasoned = (ours("kind") == "absolute") & (theirs("kind") == "season_only")
    plain = F.coalesce(ours("editions"), F.array().cast("array<int>"))
    more = F.array_except(F.coalesce(theirs("editions"), F.array().cast("array<int>")), plain)
    return rows.select(
        ours("path").alias("path"),
        title.alias("title"),
        F.coalesce(theirs("year"), ours("year")).alias("year"),
        F.concat(own, F.array_except(none, own)).alias("ids"),
        F.when(seasoned, "season_episode").otherwise(F.coalesce(ours("kind"), theirs("kind"))).alias("kind"),
        F.when(seasoned | ours("kind").isNull(), theirs("season")).otherwise(ours("season")).alias("season"),
        F.when(seasoned, F.transform(ours("numbers"), lambda n: F.least(n, F.lit(65535)))).when(ours("kind").isNull(), theirs("numbers")).otherwise(ours("numbers")).alias("numbers"),
        F.sort_array(F.concat(plain, more)).alias("editions"),
    )
