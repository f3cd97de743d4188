"""Queries on playback decisions, and the same in SQL. Orders are sources, their lines the tracks; four clients play them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import codecs
from reelspark.operators import ladders
from reelspark.sources.catalog import table

WANTED_AUDIO, WANTED_SUBTITLES = ["ja", "en"], ["en", "fr"]


def _hardware(codec: str, depth: int, width: int, height: int, **other) -> dict:
    return {"codec": codec, "profiles": [], "max_level": None, "max_bit_depth": depth, "max_chroma": "420", "max_width": width, "max_height": height, "max_bitrate_bps": None, "hardware": True} | other


# A full native client and a browser; then two that are stricter.
_NATIVE = {
    "client": "native", "containers": ["matroska", "webm", "mp4", "fragmented_mp4", "mpeg_ts", "disc_structure"],
    "decoders": [_hardware("h264", 10, 4096, 2160), _hardware("hevc", 12, 7680, 4320), _hardware("av1", 12, 7680, 4320), _hardware("vp9", 12, 7680, 4320), _hardware("mpeg2", 8, 1920, 1080), _hardware("vc1", 8, 1920, 1080, hardware=False)],
    "encodings": ["ac3", "eac3", "dts", "dts_hd_ma", "dts_x", "truehd"], "max_channels": 8, "rates": [44100, 48000, 96000, 192000], "exclusive": True, "display_width": 3840, "display_height": 2160,
    "hdr_formats": ["sdr", "hdr10", "hlg", "hdr10_plus"], "display_gamut": "dci_p3", "renderable": ["ass", "subrip", "webvtt", "pgs", "vobsub", "cea608", "cea708"], "out_of_band": True,
    "network_bps": 940_000_000, "can_tone_map": True, "transcode": "allowed", "bit_perfect": False,
}
_BROWSER = _NATIVE | {
    "client": "browser", "containers": ["fragmented_mp4", "webm"], "decoders": [_hardware("h264", 8, 3840, 2160), _hardware("vp9", 10, 3840, 2160), _hardware("av1", 10, 3840, 2160)],
    "encodings": [], "max_channels": 2, "rates": [44100, 48000], "exclusive": False, "display_width": 1920, "display_height": 1080, "hdr_formats": ["sdr"], "display_gamut": "bt709",
    "renderable": ["webvtt", "subrip"], "network_bps": 50_000_000, "can_tone_map": False,
}
_TELEVISION = _NATIVE | {
    "client": "television", "containers": ["mpeg_ts", "mp4"], "decoders": [_hardware("h264", 8, 1920, 1080, profiles=["High", "Main"], max_level=41, max_bitrate_bps=20_000_000), _hardware("hevc", 10, 3840, 2160)],
    "encodings": ["ac3", "dts"], "max_channels": 6, "rates": [48000], "exclusive": False, "renderable": ["dvbsub"], "out_of_band": False, "network_bps": None, "transcode": "audio_only", "display_gamut": "bt2020",
}
_PURIST = _NATIVE | {"client": "purist", "containers": ["matroska", "avi", "asf"], "transcode": "none", "bit_perfect": True, "encodings": ["truehd", "ac3"]}
CLIENTS = [_NATIVE, _BROWSER, _TELEVISION, _PURIST]

_AT = "CAST(({1}) % {0} + 1 AS INT)"


def _of(values: list[str], at: str, duck: bool) -> str:
    """One of the values in the SQL of either engine; an empty value is null."""
    listed, place = ", ".join(f"'{v}'" for v in values), _AT.format(len(values), at)
    return f"nullif(([{listed}])[{place}], '')" if duck else f"nullif(element_at(array({listed}), {place}), '')"


def _source_columns(duck: bool) -> dict[str, str]:
    k, c = "o_orderkey", "o_custkey"
    return {
        "source_id": k, "container": _of(["matroska", "mp4", "mpeg_ts", "avi", "webm", "asf", "flv"], c, duck), "bitrate_bps": f"CASE WHEN {k} % 9 <> 0 THEN CAST({c} % 80 * 1000000 AS BIGINT) END", "recovered_lossy": f"{k} % 31 = 0",
        "codec": _of(["h264", "hevc", "av1", "vc1", "prores", "mpeg2", "", "cook", "vp9"], f"{k} + {c}", duck), "profile": _of(["high", "Main", "baseline", ""], f"{k} * 3 + {c}", duck), "level": f"CASE WHEN {c} % 4 <> 0 THEN CAST(30 + {k} % 25 AS INT) END",
        "width": f"CAST(640 * (1 + {k} % 7) AS INT)", "height": f"CAST(360 * (1 + {k} % 7) AS INT)", "bit_depth": f"CAST(8 + {c} % 3 * 2 AS INT)", "chroma": _of(["420", "420", "420", "422", "444"], f"{k} + 2 * {c}", duck),
        "hdr": _of(["sdr", "sdr", "hdr10", "hlg", "dolby_vision_p5", "dolby_vision_p7_fel", ""], f"{k} * 5 + {c}", duck), "gamut": _of(["bt709", "bt709", "bt2020", "dci_p3", ""], f"{k} + 3 * {c}", duck),
        "video_bitrate_bps": f"CASE WHEN {k} % 4 = 0 THEN CAST({c} % 50 * 800000 AS BIGINT) END", "interlaced": f"{c} % 5 = 0",
    }


def _track_columns(duck: bool) -> dict[str, str]:
    k = "s + p + l_linenumber"
    return {
        "source_id": "l_orderkey", "idx": "l_linenumber", "audio_codec": _of(["truehd", "aac", "dts_hd_ma", "flac", "eac3", "dts_x", "opus", "cook", "pcm"], k, duck), "text_codec": _of(["subrip", "ass", "pgs", "vobsub", "cea608", "webvtt", "dvbsub"], k, duck),
        "language": _of(["en", "ja", "fr", "de", "en-us", "und", "ja"], "s + l_linenumber", duck), "channels": "CAST(s % 4 * 2 + p % 3 AS INT) + 1", "sample_rate": "CASE WHEN p % 3 = 0 THEN 44100 WHEN p % 3 = 1 THEN 48000 ELSE 96000 END",
        "a": "s % 5 = 0", "b": "p % 7 = 0", "c": "(s + p) % 6 = 0", "d": "(s + p) % 4 = 0", "e": "(s * 3 + p) % 3 = 0", "bitrate_bps": "CASE WHEN p % 5 <> 0 THEN CAST(p * 1234 AS BIGINT) END",
    }


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order on each client, with the keys that its columns are made of."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), "o_custkey")
    return rows.withColumn("client", F.explode(F.array(*(F.lit(c["client"]) for c in CLIENTS))))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    tracks = lines.selectExpr(*(f"{x} AS {n}" for n, x in _track_columns(False).items()))
    audio = tracks.filter("idx % 2 = 1").selectExpr("source_id", "idx", "audio_codec AS codec", "channels", "sample_rate", "a AS has_objects", "language", "b AS commentary", "c AS visual_impaired", "d AS original", "e AS is_default", "bitrate_bps")
    texts = tracks.filter("idx % 2 = 0").selectExpr("source_id", "idx", "text_codec AS codec", "language", "a AS forced", "c AS hearing_impaired", "d AS is_default", "e AS external")
    return ladders.select_tracks(_requests(spark, sf_dir), audio, texts, _clients(spark), WANTED_AUDIO, WANTED_SUBTITLES, prefer_original=True)


def _clients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLIENTS, ladders.CLIENT)


def track_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks that each client takes of each order."""
    return _selected(spark, sf_dir).select("source_id", "client", F.col("audio.idx").alias("audio"), F.col("subtitle.idx").alias("subtitle"))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _selected(spark, sf_dir).withColumnRenamed("source_id", "o_orderkey")
    return ladders.playback_plan(chosen.selectExpr(*(f"{x} AS {n}" for n, x in _source_columns(False).items()), "client", "audio", "subtitle"), _clients(spark))


def playback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of each order on each client; reasons in order, each with the tier it forbids."""
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("T"), r["tier"].cast("string"), F.lit(":"), r["reason"])), " ")
    video, sound = F.col("video_path"), F.col("audio_path")
    return _plans(spark, sf_dir).select(
        "source_id", "client", F.concat_ws(" ", "delivery.kind", "delivery.container").alias("delivery"), F.concat_ws(" ", video["kind"], video["codec"], video["width"].cast("string"), video["height"].cast("string"), video["bitrate_bps"].cast("string")).alias("video"),
        video["tone_map"].alias("tone_map"), video["deinterlace"].alias("deinterlace"), video["burn_in"].alias("burn_in"), F.concat_ws(" ", sound["kind"], sound["codec"], sound["channels"].cast("string"), sound["sample_rate"].cast("string")).alias("audio"),
        F.concat_ws(" ", "subtitle_path.kind", "subtitle_path.format").alias("subtitle"), "tier", reasons.alias("reasons"),
    )


def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of each client and tier."""
    return ladders.tier_histogram(_plans(spark, sf_dir))


def fidelity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that play untouched on the native client only, and that are degraded there."""
    return ladders.fidelity_summary(_plans(spark, sf_dir), "native", "browser")


QUERIES = {f.__name__: f for f in (track_selection, playback_plan, tier_histogram, fidelity_summary)}


def _text(values: list) -> str:
    return "[" + ", ".join(_value(v) for v in values) + "]" if values else "[]::VARCHAR[]"


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return _text(v)
    return f"'{v}'" if isinstance(v, str) else str(v).lower()


_DECODER_NAMES = ("codec", "profiles", "max_level", "max_bit_depth", "max_chroma", "max_width", "max_height", "max_bitrate_bps", "hardware")
_CLIENT_NAMES = [n for n in _NATIVE if n != "decoders"]
_CLIENT_ROWS = ", ".join("(" + ", ".join(_value(c[n]) for n in _CLIENT_NAMES) + ")" for c in CLIENTS)
_DECODER_ROWS = ", ".join("(" + ", ".join([_value(c["client"]), *(_value(d[n]) for n in _DECODER_NAMES)]) + ")" for c in CLIENTS for d in c["decoders"])


def _carriage(codec: str, known: list[str], carries: dict[str, str]) -> str:
    """Whether k.container carries a codec, as SQL."""
    named = f"CASE WHEN {codec} IN ({', '.join(map(repr, known))}) THEN {codec} ELSE 'other' END"
    either = [f"k.container = '{c}' AND {named} {'NOT ' * t.startswith('-')}IN ({', '.join(map(repr, t.removeprefix('- ').split()))})" for c, t in carries.items()]
    return f"({codec} IS NULL OR k.container = 'matroska' OR {' OR '.join(either)})"


def _tags(tag: str, wanted: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN split_part({tag}, '-', 1) = '{w}' THEN {len(wanted) - i}" for i, w in enumerate(wanted)) + " ELSE 0 END"


def _as(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in columns.items())


_LOSSLESS = ", ".join(map(repr, codecs.LOSSLESS))
_SELECTED = f"""cl({', '.join(_CLIENT_NAMES)}) AS (VALUES {_CLIENT_ROWS}), dec(client, {', '.join(_DECODER_NAMES)}) AS (VALUES {_DECODER_ROWS}),
src AS (SELECT {_as(_source_columns(True))} FROM orders), req AS (SELECT src.*, cl.client FROM src, cl),
trk AS (SELECT {_as(_track_columns(True))} FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)),
aud AS (SELECT source_id, client, idx, audio_codec, channels, sample_rate, a AS objects, language, row_number() OVER (PARTITION BY source_id, client ORDER BY NOT (b OR c) DESC, {_tags('language', WANTED_AUDIO)} DESC, d DESC,
  audio_codec IN ({_LOSSLESS}) AND (list_contains(encodings, audio_codec) OR channels <= max_channels) DESC, e DESC, least(channels, max_channels) DESC, coalesce(bitrate_bps, 0) // 1000 DESC, idx DESC) AS n FROM trk, cl WHERE idx % 2 = 1),
heard AS (SELECT source_id, client, aud.idx AS a_idx, audio_codec AS ac, channels AS ach, sample_rate AS arate, objects, coalesce(language, 'und') AS alang FROM req LEFT JOIN (SELECT * FROM aud WHERE n = 1) aud USING (source_id, client)),
txt AS (SELECT source_id, client, idx, text_codec, e AS outside, row_number() OVER (PARTITION BY source_id, client ORDER BY {_tags('language', WANTED_SUBTITLES)} DESC, NOT c DESC, text_codec NOT IN ('pgs', 'vobsub', 'dvbsub') DESC, d DESC, idx DESC) AS n
  FROM heard JOIN trk USING (source_id) WHERE idx % 2 = 0 AND CASE WHEN {_tags('alang', WANTED_SUBTITLES)} > 0 THEN a AND split_part(language, '-', 1) = split_part(alang, '-', 1) ELSE NOT a AND {_tags('language', WANTED_SUBTITLES)} > 0 END),
sel AS (SELECT heard.*, txt.idx AS t_idx, text_codec AS tc, outside FROM heard LEFT JOIN (SELECT * FROM txt WHERE n = 1) txt USING (source_id, client))"""

_SHOWN = "(hdr = 'sdr' OR list_contains(hdr_formats, hdr) OR hdr IN ('hdr10', 'hdr10_plus', 'dolby_vision_p8', 'dolby_vision_p7_mel', 'dolby_vision_p7_fel') AND list_contains(hdr_formats, 'hdr10'))"
_RANK = "CASE {} WHEN 'bt2020' THEN 3 WHEN 'dci_p3' THEN 2 WHEN 'display_p3' THEN 2 ELSE 1 END"
_HARD = {
    "1:VideoCodecUnsupported": "dcodec IS NULL", " 1:VideoCodecUnsupported": "len(profiles) > 0 AND NOT list_contains(list_transform(profiles, lambda x: lower(x)), lower(profile))", "  1:VideoCodecUnsupported": "level > max_level",
    "1:BitDepthUnsupported": "bit_depth > max_bit_depth", "1:ChromaSubsamplingUnsupported": "chroma > max_chroma", "1:VideoTooLarge": "width > max_width OR height > max_height", "1:BitrateCeiling": "coalesce(video_bitrate_bps, bitrate_bps) > max_bitrate_bps",
    "0:NoHardwareDecoder": "NOT hardware AND codec NOT IN ('h264', 'hevc', 'vvc', 'av1', 'vp8', 'vp9', 'mpeg2')", "1:NetworkHeadroom": "bitrate_bps > network_bps", "1:HdrUnsupportedByDisplay": f"NOT {_SHOWN}", "0:EnhancementLayerUnsupported": "hdr = 'dolby_vision_p7_fel'",
    "1:GamutUnsupportedByDisplay": f"{_RANK.format('gamut')} > {_RANK.format('display_gamut')}",
}
_MUST = " OR ".join(f"coalesce(({x}){' AND NOT can_tone_map' if n[2:] in ('HdrUnsupportedByDisplay', 'GamutUnsupportedByDisplay') else ''}, false)" for n, x in _HARD.items() if "0:" not in n)
_WHY = ", ".join(f"CASE WHEN codec IS NOT NULL AND ({x}) THEN 'T{n.strip()}' END" for n, x in _HARD.items())
_PREFER = "CASE k.container WHEN 'matroska' THEN 0 WHEN 'fragmented_mp4' THEN 1 WHEN 'mp4' THEN 2 WHEN 'mpeg_ts' THEN 3 WHEN 'webm' THEN 4 ELSE 250 END"
_CARRIES_TEXT = "CASE WHEN tc IN ('cea608', 'cea708', 'teletext') THEN {} WHEN k.container = 'matroska' THEN true " .format(_carriage("'h264'", codecs.VIDEO, codecs.CARRIES_VIDEO)) + " ".join(f"WHEN k.container = '{c}' THEN tc IN ({', '.join(map(repr, t.split()))})" for c, t in codecs.CARRIES_SUBTITLE.items()) + " ELSE false END"
#: Of the clients' rates, what the rule of related rates gives for the tracks' 44,100, 48,000 and 96,000.
_BEST_RATE = "CASE client WHEN 'television' THEN 48000 ELSE CASE arate WHEN 96000 THEN 48000 ELSE arate END END"
_PLANS = f"""WITH {_SELECTED},
tgt AS (SELECT client, codec AS tcodec, max_width AS tw, max_height AS th, CASE codec WHEN 'av1' THEN 1 WHEN 'hevc' THEN 2 ELSE 3 END AS tn FROM dec WHERE codec IN ('av1', 'hevc', 'h264')),
best AS (SELECT * FROM tgt QUALIFY row_number() OVER (PARTITION BY client ORDER BY tn) = 1),
j AS (SELECT r.* REPLACE (coalesce(hdr, 'sdr') AS hdr), sel.* EXCLUDE (source_id, client), cl.* EXCLUDE (client, container), d.* EXCLUDE (client, codec), d.codec AS dcodec, tcodec, tw, th, cl.containers AS cs FROM req r JOIN sel USING (source_id, client) JOIN (SELECT *, 0 AS container FROM cl) cl USING (client) LEFT JOIN dec d ON d.client = r.client AND d.codec = r.codec LEFT JOIN best ON best.client = r.client),
v AS (SELECT *, codec IS NOT NULL AND ({_MUST}) AS must, codec IS NOT NULL AND NOT {_SHOWN} AS tone, least(network_bps::BIGINT * 8 // 10, bitrate_bps) AS ceiling, [{_WHY}] AS why1, list_contains(cs, container) AS accepted FROM j),
w AS (SELECT *, CASE WHEN NOT must THEN 'copy' WHEN tcodec IS NULL THEN 'drop' ELSE 'transcode' END AS vk, CASE WHEN must THEN tcodec END AS vc,
  CASE WHEN a_idx IS NULL THEN 'none' WHEN list_contains(encodings, ac) THEN 'passthrough' WHEN ach <= max_channels AND list_contains(rates, arate) AND ac IN ({_LOSSLESS}) AND NOT objects AND exclusive THEN 'bit_perfect' WHEN ach <= max_channels THEN 'lpcm'
    WHEN list_contains(encodings, CASE WHEN ac = 'truehd' THEN 'ac3' WHEN ac LIKE 'dts!_%' ESCAPE '!' THEN 'dts' END) THEN 'core' ELSE 'transcode' END AS ak,
  coalesce(least(ach, max_channels), 2) AS arrive FROM v),
x AS (SELECT *, CASE WHEN ak = 'core' THEN CASE WHEN ac = 'truehd' THEN 'ac3' ELSE 'dts' END WHEN ak = 'transcode' THEN CASE WHEN arrive > 2 AND list_contains(encodings, 'eac3') THEN 'eac3' WHEN arrive > 2 AND list_contains(encodings, 'ac3') THEN 'ac3' ELSE 'aac' END END AS anew,
  CASE WHEN ak = 'transcode' THEN arrive WHEN ak = 'lpcm' THEN ach END AS achan, vk = 'copy' AND ak NOT IN ('core', 'transcode') AND accepted AS same FROM w),
pair AS (SELECT x.source_id, x.client, v.n AS vi, v.c AS vcand, v.w AS vw, v.h AS vh, a.n AS ai, a.c AS acand, k.container AS kc, row_number() OVER (PARTITION BY x.source_id, x.client ORDER BY v.n, a.n, {_PREFER}, k.place) AS n
  FROM x, LATERAL (SELECT 0 AS n, CASE WHEN vk = 'copy' THEN codec ELSE vc END AS c, NULL AS w, NULL AS h UNION ALL SELECT tn, tgt.tcodec, tgt.tw, tgt.th FROM tgt WHERE tgt.client = x.client) v,
    LATERAL (SELECT 0 AS n, CASE WHEN ak IN ('core', 'transcode') THEN anew WHEN ak <> 'none' THEN ac END AS c UNION ALL SELECT * FROM (VALUES (1, 'eac3'), (2, 'aac'), (3, 'opus'))) a,
    (SELECT client, unnest(containers) AS container, generate_subscripts(containers, 1) AS place FROM cl) k WHERE NOT same AND k.client = x.client AND {_carriage('v.c', codecs.VIDEO, codecs.CARRIES_VIDEO)} AND {_carriage('a.c', codecs.AUDIO, codecs.CARRIES_AUDIO)}),
y AS (SELECT x.*, coalesce(vi, 0) AS vi, coalesce(ai, 0) AS ai, vcand, vw, vh, acand, CASE WHEN same THEN 'original' WHEN kc IS NOT NULL THEN 'remux' ELSE 'unavailable' END AS dk, CASE WHEN same THEN x.container ELSE kc END AS dc FROM x LEFT JOIN (SELECT * FROM pair WHERE n = 1) pair USING (source_id, client)),
z AS (SELECT k.* EXCLUDE (vk, vc, ak, anew, achan, container), orig AS container, CASE WHEN vi > 0 THEN 'transcode' ELSE vk END AS vk, CASE WHEN vi > 0 THEN vcand ELSE vc END AS vc,
  CASE WHEN vi > 0 THEN CASE WHEN codec IS NULL THEN 1920 ELSE least(vw, width) END WHEN vk = 'transcode' THEN least(tw, greatest(width, 1)) END AS ow, CASE WHEN vi > 0 THEN CASE WHEN codec IS NULL THEN 1080 ELSE least(vh, height) END WHEN vk = 'transcode' THEN least(th, greatest(height, 1)) END AS oh,
  CASE WHEN ai > 0 THEN 'transcode' ELSE ak END AS ak, CASE WHEN ai > 0 THEN acand ELSE anew END AS anew, CASE WHEN ai > 0 THEN arrive ELSE achan END AS achan,
  CASE WHEN dk = 'remux' THEN {_CARRIES_TEXT} ELSE NOT outside END AS carried, list_contains(renderable, tc) AS drawn, CASE WHEN list_contains(renderable, 'webvtt') THEN 'webvtt' WHEN list_contains(renderable, 'subrip') THEN 'subrip' END AS plain,
  (SELECT arg_min(tgt.tcodec, tgt.tn) FROM tgt WHERE tgt.client = k.client AND (k.container IS NULL OR {_carriage('tgt.tcodec', codecs.VIDEO, codecs.CARRIES_VIDEO)})) AS burn
  FROM (SELECT * EXCLUDE (container), container AS orig, dc AS container FROM y) k),
s AS (SELECT *, CASE WHEN t_idx IS NULL THEN 'none' WHEN drawn AND (carried OR tc IN ('cea608', 'cea708', 'teletext') AND NOT outside) THEN 'in_band' WHEN drawn AND out_of_band THEN 'own' WHEN tc NOT IN ('pgs', 'vobsub', 'dvbsub') AND out_of_band AND plain IS NOT NULL THEN 'converted' ELSE 'burned_in' END AS sk FROM z),
t AS (SELECT * REPLACE (CASE WHEN sk = 'burned_in' AND vk = 'copy' THEN CASE WHEN burn IS NULL THEN 'drop' ELSE 'transcode' END ELSE vk END AS vk, CASE WHEN sk = 'burned_in' AND vk = 'copy' THEN burn ELSE vc END AS vc,
    CASE WHEN sk = 'burned_in' AND vk = 'copy' AND burn IS NOT NULL THEN least(display_width, width) ELSE ow END AS ow, CASE WHEN sk = 'burned_in' AND vk = 'copy' AND burn IS NOT NULL THEN least(display_height, height) ELSE oh END AS oh),
  CASE WHEN sk = 'burned_in' AND vk = 'copy' AND burn IS NOT NULL THEN network_bps::BIGINT * 8 // 10 WHEN vk = 'transcode' THEN ceiling END AS rate, vk = 'transcode' AND tone AS tm, vk = 'transcode' AND codec IS NOT NULL AND interlaced AS di,
  CASE WHEN ak = 'lpcm' THEN CASE WHEN list_contains(rates, arate) THEN arate ELSE {_BEST_RATE} END END AS orate FROM s),
u AS (SELECT *, codec IS NULL AND a_idx IS NULL AS nothing, CASE WHEN recovered_lossy THEN 4 WHEN vk <> 'copy' OR sk = 'burned_in' THEN 3 WHEN ak IN ('transcode', 'lpcm') AND achan < ach THEN 3 WHEN ak IN ('transcode', 'core') THEN 2 WHEN ak = 'lpcm' THEN CASE WHEN orate <> arate OR objects THEN 2 ELSE 1 END WHEN dk = 'original' THEN 0 ELSE 1 END AS best_tier,
  CASE transcode WHEN 'audio_only' THEN vk <> 'copy' WHEN 'none' THEN vk <> 'copy' OR ak = 'transcode' OR sk = 'burned_in' OR dk <> 'original' ELSE false END AS against FROM t),
p AS (SELECT *, nothing OR dk = 'unavailable' OR against AS blocked, CASE WHEN nothing THEN 'T0:ContainerUnsupported' ELSE array_to_string(list_filter(list_concat(why1, [CASE WHEN must AND tcodec IS NULL THEN 'T3:VideoCodecUnsupported' END,
  CASE WHEN a_idx IS NOT NULL AND NOT list_contains(encodings, ac) THEN 'T0:SinkLacksEncoding' END, CASE WHEN a_idx IS NOT NULL AND NOT list_contains(encodings, ac) AND ach > max_channels THEN 'T1:ChannelCountUnsupported' END, CASE WHEN a_idx IS NOT NULL AND NOT list_contains(encodings, ac) AND NOT list_contains(rates, arate) THEN 'T1:SampleRateUnsupported' END,
  CASE WHEN NOT accepted THEN 'T0:ContainerUnsupported' END, CASE WHEN dk = 'unavailable' THEN 'T3:ContainerUnsupported' END, CASE WHEN sk = 'burned_in' THEN 'T2:SubtitleBurnInRequired' END, CASE WHEN recovered_lossy THEN 'T0:SourceIncomplete' END, CASE WHEN against AND dk <> 'unavailable' THEN 'T0:UserPolicy' END]), lambda q: q IS NOT NULL), ' ') END AS reasons FROM u),
plans AS (SELECT source_id, client, CASE WHEN blocked THEN concat_ws(' ', 'original', container) ELSE concat_ws(' ', dk, dc) END AS delivery, CASE WHEN blocked THEN 'copy' ELSE concat_ws(' ', vk, vc, ow, oh, rate) END AS video, tm AND NOT blocked AS tone_map, di AND NOT blocked AS deinterlace,
  NOT blocked AND sk = 'burned_in' AND vk = 'transcode' AS burn_in, CASE WHEN blocked THEN 'none' ELSE concat_ws(' ', ak, anew, achan, orate) END AS audio, CASE WHEN blocked THEN 'none' WHEN sk = 'own' THEN 'out_of_band ' || tc WHEN sk = 'converted' THEN 'out_of_band ' || plain ELSE sk END AS subtitle,
  CASE WHEN blocked THEN 5 ELSE best_tier END AS tier, reasons FROM p)"""
ORACLES: dict[str, str] = {
    "track_selection": f"WITH {_SELECTED} SELECT source_id, client, a_idx AS audio, t_idx AS subtitle FROM sel",
    "playback_plan": f"{_PLANS} SELECT * FROM plans",
    "tier_histogram": f"{_PLANS} SELECT client, tier, count(*) AS n FROM plans GROUP BY client, tier",
    "fidelity_summary": f"""{_PLANS}, d AS (SELECT source_id, client, tier, tier < 5 AND video LIKE 'copy%' AND audio NOT LIKE 'transcode%' AND subtitle <> 'burned_in' AS direct FROM plans)
SELECT count(*) AS n_sources, count(*) FILTER (a.direct AND NOT b.direct) AS n_native_only, count(*) FILTER (a.tier > 2) AS n_degraded FROM d a JOIN d b USING (source_id) WHERE a.client = 'native' AND b.client = 'browser'""",
}
