"""How a client would play a source: tracks to take, what to copy or convert, the tier that is left, and why.

Requests are rows of (source_id, client). Clients are a small dimension (at most MOST_CLIENTS rows, checked), so it is broadcast, and after the choice
of tracks all decisions are expressions on one row: no shuffle, no Python. What depends on the client alone (its decoders by codec, which of its containers
carry a codec) is worked out once a client, before the broadcast, so that a row only looks it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import codecs, language

MOST_CLIENTS = 10_000
#: Bytes of a method that HotSpot still compiles.
JIT_LIMIT = 8000
#: Requests for each task that chooses tracks, so that a task's memory does not grow with the table.
REQUESTS_A_TASK = 250_000
TARGETS = ("av1", "hevc", "h264")
#: What sound is converted to.
INTO = ("eac3", "ac3", "aac", "opus")

DECODER = "struct<codec: string, profiles: array<string>, max_level: int, max_bit_depth: int, max_chroma: string, max_width: int, max_height: int, max_bitrate_bps: bigint, hardware: boolean>"
CLIENT = (
    f"client string, decoders array<{DECODER}>, containers array<string>, encodings array<string>, max_channels int, rates array<int>, exclusive boolean, display_width int, display_height int, "
    "hdr_formats array<string>, display_gamut string, renderable array<string>, out_of_band boolean, network_bps bigint, can_tone_map boolean, transcode string, bit_perfect boolean"
)


def _small(clients: DataFrame) -> DataFrame:
    if clients.limit(MOST_CLIENTS + 1).count() > MOST_CLIENTS:
        raise ValueError(f"more than {MOST_CLIENTS} clients")
    return F.broadcast(clients)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _points(tagged: Column, wanted: list[str]) -> Column:
    """More for a tag of an earlier wanted language; 0 for none."""
    out = F.lit(0)
    for k, w in reversed(list(enumerate(wanted))):
        if w != "und":
            out = F.when(language.base(tagged) == w.split("-")[0], len(wanted) - k).otherwise(out)
    return out


def select_tracks(
    requests: DataFrame, audio: DataFrame, subtitles: DataFrame, clients: DataFrame, wanted_audio: list[str], wanted_subtitles: list[str], *,
    prefer_original: bool = False, prefer_sdh: bool = False, always_show: bool = False, forced_audio: int | None = None, forced_subtitle: int | None = None,
) -> DataFrame:
    """The requests with structs ``audio`` and ``subtitle`` of the tracks to take (null for none).

    requests: source_id, client and any other columns; clients as CLIENT; audio: source_id, idx, codec, channels, sample_rate, has_objects, language, commentary, visual_impaired, original, is_default,
    bitrate_bps; subtitles: source_id, idx, codec, language, forced, hearing_impaired, is_default, external. Wanted languages are normalised tags.

    Audio goes by: no commentary or description, language, original (if preferred), lossless where the sink can use it, default, channels that arrive, bitrate; the last of equals wins. A forced audio
    index that a source lacks is ignored. If the audio's language is one of the wanted subtitle languages, only forced subtitles in it are shown (unless all are to be); otherwise the best unforced one in a wanted
    language. A forced subtitle index that a source lacks gives none. Null flags are false, null channels two, null languages undetermined. A request with a null source_id has no tracks. Repeated requests each get
    the same tracks.
    """
    caps = _small(clients.select("client", "encodings", "max_channels", F.lit(True).alias("known")))
    n = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), requests.select("client").count() // REQUESTS_A_TASK + 1)
    asked = requests.select("source_id", "client").filter("source_id IS NOT NULL").repartition(n, "source_id").distinct()
    tag, channels = language.tag(F.col("language")), F.coalesce("channels", F.lit(2))
    # all that a track scores without a client, once a track
    audio = audio.select("source_id", "idx", "codec", "sample_rate", channels.alias("channels"), _yes(F.col("has_objects")).alias("has_objects"), tag.alias("language"), *(c.alias(k) for k, c in {
        "asked_for": F.lit(False) if forced_audio is None else F.col("idx") == forced_audio, "plain": ~(_yes(F.col("commentary")) | _yes(F.col("visual_impaired"))), "points": _points(tag, wanted_audio),
        "first_made": F.lit(prefer_original) & _yes(F.col("original")), "lossless": _yes(F.col("codec").isin(*codecs.LOSSLESS)), "is_default": _yes(F.col("is_default")), "kbps": F.floor(F.coalesce("bitrate_bps", F.lit(0)) / 1000), "there": F.lit(True),
    }.items()))
    usable = _yes(F.array_contains("encodings", F.col("codec"))) | (F.col("channels") <= F.col("max_channels"))
    score = [F.col("asked_for"), F.col("plain"), F.col("points"), F.col("first_made"), _yes(F.col("lossless") & usable), F.col("is_default"), F.least("channels", "max_channels"), F.col("kbps")]
    kept = ("idx", "codec", "channels", "sample_rate", "has_objects", "language")
    track = F.when(F.col("there") & F.col("known"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(score)), *kept))
    heard = asked.join(audio.hint("merge"), "source_id", "left").join(caps, "client", "left").groupBy("source_id", "client").agg(F.max(track).alias("t"))
    heard = heard.select("source_id", "client", F.when(F.col("t").isNotNull(), F.struct(*(F.col(f"t.{x}").alias(x) for x in kept))).alias("audio"))
    # a source's subtitles depend on the client by the audio's language alone: the best forced one of each wanted language, and the best of the others
    bases = list(dict.fromkeys(w.split("-")[0] for w in wanted_subtitles if w != "und"))
    texts = subtitles.select("source_id", "idx", "codec", tag.alias("tag"), _points(tag, wanted_subtitles).alias("points"), *(_yes(F.col(x)).alias(x) for x in ("forced", "hearing_impaired", "is_default", "external")))
    score = [F.col("points"), F.col("hearing_impaired") == F.lit(prefer_sdh), ~F.col("codec").isin(*codecs.BITMAP), F.col("is_default")]
    line = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(score)), "idx", "codec", "external")
    if forced_subtitle is not None:
        ways = {"other": F.col("idx") == forced_subtitle}
    else:
        ways = {"other": ~F.col("forced") & (F.col("points") > 0)}
        if not always_show:
            ways |= {f"forced{i}": F.col("forced") & (F.col("tag") != "und") & (language.base(F.col("tag")) == w) for i, w in enumerate(bases)}
    read = texts.groupBy("source_id").agg(*(F.max(F.when(c, line)).alias(k) for k, c in ways.items()))
    chosen, own = F.col("other"), language.base(F.coalesce("audio.language", F.lit("und")))
    for i, w in reversed(list(enumerate(bases))):
        if f"forced{i}" in ways:
            chosen = F.when(own == w, F.col(f"forced{i}")).otherwise(chosen)
    both = heard.join(read.hint("merge"), "source_id", "left").select("source_id", "client", "audio", chosen.alias("t"))
    both = both.select("source_id", "client", "audio", F.when(F.col("t").isNotNull(), F.struct(*(F.col(f"t.{x}").alias(x) for x in ("idx", "codec", "external")))).alias("subtitle"))
    return requests.drop("audio", "subtitle").repartition(n, "source_id", "client").join(both.hint("merge"), ["source_id", "client"], "left")


def _reason(tier: int, name: str, when: Column) -> Column:
    """A list of the reason, or an empty one."""
    return F.when(when, F.array(F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("reason")))).otherwise(F.array().cast("array<struct<tier: int, reason: string>>"))


def _decoder(codec: Column) -> Column:
    return F.try_element_at("by_codec", codec)


def _prepared(clients: DataFrame) -> DataFrame:
    """The clients with what their rows alone decide.

    by_codec: the first decoder of each codec, profiles in lower case; target: the first of TARGETS they decode; able<i>, width<i> and height<i>: whether they decode TARGETS[i], and up to which size; ranked: their
    containers in order of preference, each known one once and the first unknown one; every: a bit for each of these; video_bits and audio_bits: by codec, a bit for each of these that carries it; target<i> and
    <codec>_bits: the same for TARGETS (0 if not decoded) and for the codecs that sound is converted to.
    """
    first = F.filter("decoders", lambda d, i: d["codec"].isNotNull() & (F.array_position(F.col("decoders.codec"), d["codec"]) == i + 1))
    by_codec = F.map_from_entries(F.transform(first, lambda d: F.struct(d["codec"], d.withField("profiles", F.transform(d["profiles"], F.lower)))))
    known = codecs.carriers(None, codecs.CARRIES_VIDEO)
    unknown = F.array_position(F.transform("containers", lambda c: ~_yes(c.isin(*known))), True)
    once = F.filter("containers", lambda c, i: F.when(_yes(c.isin(*known)), F.array_position("containers", c)).otherwise(unknown) == i + 1)
    ranked = F.transform(F.array_sort(F.transform(once, lambda c, i: F.struct(codecs.remux_rank(c).alias("rank"), i.alias("place"), c.alias("container")))), lambda x: x["container"])
    clients = clients.withColumns({"by_codec": by_codec, "ranked": ranked}).drop("decoders")
    clients = clients.withColumn("able", F.filter(F.array(*(F.lit(c) for c in TARGETS)), lambda c: _decoder(c).isNotNull()))

    def bits(names: list[str], table: dict[str, str]) -> Column:
        carried = F.create_map(*(x for v in [*names, "other"] for x in (F.lit(v), F.array(*(F.lit(c) for c in codecs.carriers(v if v in names else "other", table))))))
        return F.transform_values(carried, lambda _, some: F.aggregate(F.reverse("ranked"), F.lit(0), lambda m, c: m * 2 + _yes(F.array_contains(some, c)).cast("int")))

    clients = clients.withColumns({"every": F.aggregate("ranked", F.lit(0), lambda m, c: m * 2 + 1), "video_bits": bits(codecs.VIDEO, codecs.CARRIES_VIDEO), "audio_bits": bits(codecs.AUDIO, codecs.CARRIES_AUDIO)})
    clients = clients.withColumns({f"{a}_bits": F.element_at("audio_bits", F.lit(a)) for a in INTO} | {"target": F.get("able", F.lit(0))})
    for i, c in enumerate(TARGETS):
        aim = _decoder(F.lit(c))
        clients = clients.withColumns({f"able{i}": _yes(F.array_contains("able", c)), f"width{i}": aim["max_width"], f"height{i}": aim["max_height"], f"target{i}": F.when(F.array_contains("able", c), F.element_at("video_bits", F.lit(c))).otherwise(0)})
    return clients.drop("able")


def _looked_up(rows: DataFrame) -> DataFrame:
    """All that needs a client's lists and maps, in one go, so that later steps carry numbers instead of them."""
    codec, core, drawn = F.col("audio.codec"), codecs.core_of(F.col("audio.codec")), F.col("subtitle.codec")

    def bits(table: str, codec: Column) -> Column:
        return F.when(codec.isNull(), F.col("every")).otherwise(F.coalesce(F.try_element_at(table, codec), F.element_at(table, F.lit("other"))))

    rows = rows.withColumns({
        "decoder": _decoder(F.col("codec")), "hdr": F.coalesce("hdr", F.lit("sdr")), "shown": codecs.shows_hdr(F.col("hdr_formats"), F.coalesce("hdr", F.lit("sdr"))), "codec_bits": bits("video_bits", F.col("codec")),
        "sound_bits": bits("audio_bits", codec), "core_bits": bits("audio_bits", core), "whole": _yes(F.array_contains("encodings", codec)), "core_fits": _yes(F.array_contains("encodings", core)),
        "takes_eac3": F.array_contains("encodings", "eac3"), "takes_ac3": F.array_contains("encodings", "ac3"), "rate_ok": _yes(F.array_contains("rates", F.col("audio.sample_rate").cast("int"))),
        "accepted": _yes(F.array_contains("containers", F.col("container"))), "drawn": _yes(F.array_contains("renderable", drawn)),
        "text": F.when(F.array_contains("renderable", "webvtt"), "webvtt").when(F.array_contains("renderable", "subrip"), "subrip"),
    })
    return rows.drop("by_codec", "hdr_formats", "video_bits", "audio_bits", "encodings", "containers", "renderable")


def _aim(side: str, codec: Column) -> Column:
    """Up to which width or height the client decodes one of TARGETS."""
    return F.coalesce(*(F.when(codec == c, F.col(f"{side}{i}")) for i, c in enumerate(TARGETS)))


def _path(kind: Column | str, codec: Column, width: Column, height: Column, bitrate: Column, tone_map: Column, deinterlace: Column, burn_in: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), codec.alias("codec"), width.cast("int").alias("width"), height.cast("int").alias("height"), bitrate.cast("long").alias("bitrate_bps"), tone_map.alias("tone_map"), deinterlace.alias("deinterlace"), burn_in.alias("burn_in"))


def _plain(kind: str) -> Column:
    none, no = F.lit(None), F.lit(False)
    return _path(kind, none.cast("string"), none, none, none, no, no, no)


def _sound(kind: str, codec: Column | None = None, channels: Column | None = None, rate: Column | None = None, resampled: Column | None = None, lost: Column | None = None) -> Column:
    none, no = F.lit(None), F.lit(False)
    parts = (("kind", F.lit(kind)), ("codec", (codec if codec is not None else none).cast("string")), ("channels", (channels if channels is not None else none).cast("int")), ("sample_rate", (rate if rate is not None else none).cast("int")))
    return F.struct(*(c.alias(n) for n, c in parts), (resampled if resampled is not None else no).alias("resampled"), (lost if lost is not None else no).alias("objects_lost"))


def decide_video(rows: DataFrame) -> DataFrame:
    """L2: adds ``video_path`` and ``reasons``; copied unless a rule forbids it, dropped without anything to convert to."""
    have = F.col("codec").isNotNull()
    rows = rows.withColumn("ceiling", F.least(F.floor(F.col("network_bps") * 8 / 10), F.col("bitrate_bps")))
    d = F.col("decoder")
    profile = F.lower("profile")
    shown, wide = F.col("shown"), codecs.gamut_rank(F.col("gamut")) <= codecs.gamut_rank(F.col("display_gamut"))
    listed = F.array_contains(d["profiles"], profile)
    rules = [
        (1, "VideoCodecUnsupported", d.isNull()), (1, "VideoCodecUnsupported", (F.size(d["profiles"]) > 0) & ~listed), (1, "VideoCodecUnsupported", F.col("level") > d["max_level"]),
        (1, "BitDepthUnsupported", F.col("bit_depth") > d["max_bit_depth"]), (1, "ChromaSubsamplingUnsupported", F.col("chroma") > d["max_chroma"]), (1, "VideoTooLarge", _yes(F.col("width") > d["max_width"]) | _yes(F.col("height") > d["max_height"])),
        (1, "BitrateCeiling", F.coalesce("video_bitrate_bps", "bitrate_bps") > d["max_bitrate_bps"]), (0, "NoHardwareDecoder", d.isNotNull() & ~_yes(d["hardware"]) & ~F.col("codec").isin(*codecs.HARDWARE_USUAL)),
        (1, "NetworkHeadroom", F.col("bitrate_bps") > F.col("network_bps")), (1, "HdrUnsupportedByDisplay", ~shown), (0, "EnhancementLayerUnsupported", F.col("hdr") == "dolby_vision_p7_fel"), (1, "GamutUnsupportedByDisplay", ~wide),
    ]
    no_map = ~_yes(F.col("can_tone_map"))
    must = F.lit(False)
    for tier, name, when in rules:
        if tier:
            must = must | (_yes(when) & (no_map if name in ("HdrUnsupportedByDisplay", "GamutUnsupportedByDisplay") else F.lit(True)))
    must = have & must
    found = [_reason(tier, name, have & _yes(when)) for tier, name, when in rules]
    rows = rows.withColumns({"must": must, "tone_map": have & ~_yes(shown)})
    convert = _path("transcode", F.col("target"), F.least(_aim("width", F.col("target")), F.greatest("width", F.lit(1))), F.least(_aim("height", F.col("target")), F.greatest("height", F.lit(1))), F.col("ceiling"), F.col("tone_map"), _yes(F.col("interlaced")), F.lit(False))
    path = F.when(~F.col("must"), _plain("copy")).when(F.col("target").isNotNull(), convert).otherwise(_plain("drop"))
    return rows.withColumns({"video_path": path, "reasons": F.concat(*found, _reason(3, "VideoCodecUnsupported", F.col("must") & F.col("target").isNull()))})


def _rate(rates: Column, source: Column) -> Column:
    """A rate of the sink for a source's: related to it rather than not, and as high as possible without passing it."""
    def related(a: Column) -> Column:
        return _yes(F.try_mod(source, a) == 0) | _yes(F.try_mod(a, source) == 0)

    def better(best: Column, r: Column) -> Column:
        return F.when((related(r) & ~related(best)) | ((r > best) & _yes(r <= source)), r).otherwise(best)

    return F.aggregate(rates, F.coalesce(F.get(rates, F.lit(0)), F.lit(48_000)).cast("int"), better)


def decide_audio(rows: DataFrame) -> DataFrame:
    """L3: adds ``audio_path`` and reasons: passed through, bit-perfect, decoded, its core, or converted."""
    codec, channels, rate, objects = F.col("audio.codec"), F.col("audio.channels"), F.col("audio.sample_rate").cast("int"), _yes(F.col("audio.has_objects"))
    have, whole = F.col("audio").isNotNull(), F.col("whole")
    fit, rate_ok = _yes(channels <= F.col("max_channels")), F.col("rate_ok")
    core, arrive = codecs.core_of(codec), F.least(channels, "max_channels")
    into = F.when((arrive > 2) & F.col("takes_eac3"), "eac3").when((arrive > 2) & F.col("takes_ac3"), "ac3").otherwise("aac")
    path = F.when(~have, _sound("none")).when(whole, _sound("passthrough")).when(fit & rate_ok & _yes(codec.isin(*codecs.LOSSLESS)) & ~objects & _yes(F.col("exclusive")), _sound("bit_perfect"))
    path = path.when(fit, _sound("lpcm", None, channels, F.when(rate_ok, rate).otherwise(_rate(F.col("rates"), rate)), ~rate_ok, objects))
    path = path.when(F.col("core_fits"), _sound("core", core)).otherwise(_sound("transcode", into, arrive))
    found = [_reason(0, "SinkLacksEncoding", have & ~whole), _reason(1, "ChannelCountUnsupported", have & ~whole & ~fit), _reason(1, "SampleRateUnsupported", have & ~whole & ~rate_ok)]
    return rows.withColumns({"audio_path": path, "reasons": F.concat("reasons", *found)})


def decide_container(rows: DataFrame) -> DataFrame:
    """Adds ``delivery`` (kind, container); of the pairs of video and audio codecs to deliver, the first that a container of the client carries."""
    video, sound = F.col("video_path"), F.col("audio_path")
    accepted, into = F.col("accepted"), F.col("audio_path.codec")
    same = (video["kind"] == "copy") & ~sound["kind"].isin("transcode", "core") & accepted
    out_video = F.when(video["kind"] == "copy", F.col("codec")).otherwise(video["codec"])
    out_audio = F.when(sound["kind"].isin("transcode", "core"), sound["codec"]).when(sound["kind"] != "none", F.col("audio.codec"))
    v0 = F.when(video["kind"] == "copy", F.col("codec_bits")).when(video["kind"] == "drop", F.col("every")).otherwise(F.coalesce(*(F.when(video["codec"] == c, F.col(f"target{i}")) for i, c in enumerate(TARGETS))))
    a0 = F.when(sound["kind"] == "core", F.col("core_bits")).when(sound["kind"] == "transcode", F.coalesce(*(F.when(into == c, F.col(f"{c}_bits")) for c in INTO))).when(sound["kind"] == "none", F.col("every")).otherwise(F.col("sound_bits"))
    rows = rows.withColumns({"same": same, "out_video": out_video, "out_audio": out_audio, "v0": v0, "a0": a0})
    videos = [("out_video", F.col("v0"))] + [(F.lit(c), F.col(f"target{i}")) for i, c in enumerate(TARGETS)]
    audios = [("out_audio", F.col("a0"))] + [(F.lit(c), F.col(f"{c}_bits")) for c in ("eac3", "aac", "opus")]
    pair = None
    for i, (_, v) in enumerate(videos):
        for j, (_, a) in enumerate(audios):
            fits = v.bitwiseAND(a) != 0
            if i + j == 0:  # without streams the first container will do, even an unknown one
                fits = F.when(F.col("out_video").isNull() & F.col("out_audio").isNull(), F.get("ranked", F.lit(0)).isNotNull()).otherwise(fits)
            pair = (F if pair is None else pair).when(fits, 4 * i + j)
    rows = rows.withColumn("pair", F.when(~F.col("same"), pair))
    vi, ai = F.shiftright("pair", 2), F.col("pair").bitwiseAND(3)

    def pick(place: Column, some: list) -> Column:
        found = None
        for i, c in enumerate(some):
            found = (F if found is None else found).when(place == i, F.col(c) if isinstance(c, str) else c)
        return found

    rows = rows.withColumn("carry", pick(vi, [v for _, v in videos]).bitwiseAND(pick(ai, [a for _, a in audios])))
    lowest = F.bit_count(F.col("carry").bitwiseAND(-F.col("carry")) - 1)
    hit = {"v": pick(vi, [c for c, _ in videos]), "a": pick(ai, [c for c, _ in audios]), "container": F.get("ranked", lowest), "vi": vi, "ai": ai}
    rows = rows.withColumn("hit", F.when(F.col("pair").isNotNull(), F.struct(*(c.alias(k) for k, c in hit.items())))).drop("ranked")
    hit = F.col("hit")
    new_video = _path("transcode", hit["v"], F.when(F.col("codec").isNull(), 1920).otherwise(F.least(_aim("width", hit["v"]), "width")), F.when(F.col("codec").isNull(), 1080).otherwise(F.least(_aim("height", hit["v"]), "height")), F.col("ceiling"), F.col("tone_map"), _yes(F.col("codec").isNotNull() & F.col("interlaced")), F.lit(False))
    new_audio = _sound("transcode", hit["a"], F.coalesce(F.least(F.col("audio.channels"), F.col("max_channels")), F.lit(2)))
    kind = F.when(F.col("same"), "original").when(hit.isNotNull(), "remux").otherwise("unavailable")
    return rows.withColumns({
        "delivery": F.struct(kind.alias("kind"), F.when(F.col("same"), F.col("container")).otherwise(hit["container"]).alias("container")),
        "video_path": F.when(hit["vi"] > 0, new_video).otherwise(video), "audio_path": F.when(hit["ai"] > 0, new_audio).otherwise(sound),
        "reasons": F.concat("reasons", _reason(0, "ContainerUnsupported", ~accepted), _reason(3, "ContainerUnsupported", kind == "unavailable")),
    })


def decide_subtitle(rows: DataFrame) -> DataFrame:
    """Adds ``subtitle_path`` (kind, format); burning a subtitle in makes the video a conversion, or drops it without a codec for that."""
    codec, outside, video = F.col("subtitle.codec"), _yes(F.col("subtitle.external")), F.col("video_path")
    drawn, beside = F.col("drawn"), _yes(F.col("out_of_band"))
    carried = F.when(F.col("delivery.kind") == "remux", codecs.carries_subtitle(F.col("delivery.container"), codec)).otherwise(~outside)
    text = F.col("text")
    kind = F.when(F.col("subtitle").isNull(), "none").when(codec.isin(*codecs.CAPTIONS) & ~outside & drawn, "in_band").when(drawn & _yes(carried), "in_band").when(drawn & beside, "out_of_band")
    kind = kind.when(~_yes(codec.isin(*codecs.BITMAP)) & beside & text.isNotNull(), "converted").otherwise("burned_in")
    target = F.coalesce(*(F.when(F.col(f"able{i}") & F.col("delivery.container").isin(*codecs.carriers(c, codecs.CARRIES_VIDEO)), F.lit(c)) for i, c in enumerate(TARGETS)))
    rows = rows.withColumns({"way": kind, "burn_target": target})
    burn = F.col("way") == "burned_in"
    into = F.when(F.col("delivery.container").isNull(), F.col("target")).otherwise(F.col("burn_target"))
    fresh = _path("transcode", into, F.least("display_width", "width"), F.least("display_height", "height"), F.floor(F.col("network_bps") * 8 / 10), F.lit(False), F.lit(False), F.lit(True))
    again = _path(video["kind"], *(video[x] for x in ("codec", "width", "height", "bitrate_bps", "tone_map", "deinterlace")), F.lit(True))
    path = F.when(~burn | (video["kind"] == "drop"), video).when(video["kind"] == "transcode", again).when(into.isNotNull(), fresh).otherwise(_plain("drop"))
    way = F.when(F.col("way") == "converted", "out_of_band").otherwise(F.col("way"))
    form = F.when(F.col("way") == "converted", text).when(F.col("way") == "out_of_band", codec)
    return rows.withColumns({"video_path": path, "subtitle_path": F.struct(way.alias("kind"), form.alias("format")), "reasons": F.concat("reasons", _reason(2, "SubtitleBurnInRequired", burn))})


def playback_plan(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """One plan a request: source_id, client, delivery, video_path, audio_path, subtitle_path, tier (0 bit-exact to 5 blocked) and reasons (tier, reason).

    requests: source_id, client, audio and subtitle as select_tracks gives them, container, bitrate_bps, recovered_lossy, and the video stream's codec (null for no video), profile, level, width, height, bit_depth,
    chroma ('420', '422', '444'), hdr, gamut, video_bitrate_bps, interlaced. Other columns are ignored. A request without video and audio, or that no container can carry, or against the client's policy is blocked
    and keeps its reasons. What is null passes its test. Requests of unknown clients give no row; repeated requests repeat their plan. Tone-mapping curves are not built.
    """
    # the JVM only interprets methods above this size; rows' expressions in smaller ones are compiled
    requests.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    used = ["source_id", "client", "audio", "subtitle", "container", "bitrate_bps", "recovered_lossy", "codec", "profile", "level", "width", "height", "bit_depth", "chroma", "hdr", "gamut", "video_bitrate_bps", "interlaced"]
    rows = requests.select(*used).join(_small(_prepared(clients)), "client")
    rows = decide_subtitle(decide_container(decide_audio(decide_video(_looked_up(rows)))))
    video, sound, sub = F.col("video_path"), F.col("audio_path"), F.col("subtitle_path")
    lossy = _yes(F.col("recovered_lossy"))
    fewer = sound["channels"] < F.col("audio.channels")
    tier = F.when(lossy, 4).when((video["kind"] != "copy") | (sub["kind"] == "burned_in"), 3).when(sound["kind"].isin("transcode", "lpcm") & fewer, 3)
    tier = tier.when(sound["kind"].isin("transcode", "core"), 2).when(sound["kind"] == "lpcm", F.when(sound["resampled"] | sound["objects_lost"], 2).otherwise(1)).otherwise(F.when(F.col("delivery.kind") == "original", 0).otherwise(1))
    rows = rows.withColumns({"tier": tier, "reasons": F.concat("reasons", _reason(0, "SourceIncomplete", lossy))})
    direct = (video["kind"] == "copy") & (sound["kind"] != "transcode") & (sub["kind"] != "burned_in")
    against = F.when(F.col("transcode") == "audio_only", video["kind"] != "copy").when(F.col("transcode") == "none", ~direct | (F.col("delivery.kind") != "original")).otherwise(False)
    empty, lost = F.col("codec").isNull() & F.col("audio").isNull(), F.col("delivery.kind") == "unavailable"
    rows = rows.withColumns({"empty": empty, "against": ~empty & ~lost & against, "blocked": empty | lost | against})
    blocked = F.col("blocked")
    reasons = F.when(F.col("empty"), F.array(F.struct(F.lit(0).alias("tier"), F.lit("ContainerUnsupported").alias("reason")))).otherwise(F.concat("reasons", _reason(0, "UserPolicy", F.col("against"))))
    return rows.select(
        "source_id", "client", F.when(blocked, F.struct(F.lit("original").alias("kind"), F.col("container").alias("container"))).otherwise(F.col("delivery")).alias("delivery"), F.when(blocked, _plain("copy")).otherwise(video).alias("video_path"),
        F.when(blocked, _sound("none")).otherwise(sound).alias("audio_path"), F.when(blocked, F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("format"))).otherwise(sub).alias("subtitle_path"), F.when(blocked, 5).otherwise(F.col("tier")).alias("tier"), reasons.alias("reasons"),
    )


def tier_histogram(plans: DataFrame) -> DataFrame:
    """Plans of each client and tier."""
    return plans.groupBy("client", "tier").agg(F.count("*").alias("n"))


def fidelity_summary(plans: DataFrame, native: str, browser: str) -> DataFrame:
    """One row: sources planned on both clients, of these direct on the native one only, and below tier 2 there. One shuffle by source; blocked is not direct."""
    touched = (F.col("video_path.kind") != "copy") | (F.col("audio_path.kind") == "transcode") | (F.col("subtitle_path.kind") == "burned_in") | (F.col("tier") == 5)
    here, there = F.col("client") == native, F.col("client") == browser
    rows = plans.filter(here | there).groupBy("source_id").agg(F.bool_or(here & ~touched).alias("direct"), F.bool_or(there & ~touched).alias("beside"), F.max(F.when(here, F.col("tier"))).alias("tier"), F.bool_or(there).alias("both"))
    rows = rows.filter("both AND tier IS NOT NULL")
    return rows.agg(F.count("*").alias("n_sources"), F.count_if(F.col("direct") & ~F.col("beside")).alias("n_native_only"), F.count_if(F.col("tier") > 2).alias("n_degraded"))
