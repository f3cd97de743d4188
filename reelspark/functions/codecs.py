"""Codecs, containers and displays, as column expressions. Codecs that no list names count as "other"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codecs with a name of their own.
VIDEO = ["h264", "hevc", "vvc", "av1", "vp8", "vp9", "mpeg1", "mpeg2", "mpeg4", "vc1", "theora", "prores", "prores_raw", "dnxhd", "apv", "ffv1", "mjpeg", "dv", "uncompressed", "h263", "cinepak", "indeo", "svq3", "qtrle", "utvideo"]
AUDIO = ["truehd", "dts_hd_ma", "dts_x", "dts_hd_hra", "flac", "alac", "wavpack", "monkeys_audio", "pcm", "dsd", "wma_lossless", "ac3", "eac3", "ac4", "dts", "aac", "opus", "vorbis", "mp3", "mp2", "wma", "adpcm"]
# Traits of codecs.
HARDWARE_USUAL = ["h264", "hevc", "vvc", "av1", "vp8", "vp9", "mpeg2"]
INTERMEDIATE = ["prores", "prores_raw", "dnxhd", "apv", "ffv1", "uncompressed", "utvideo"]
LOSSLESS = ["truehd", "dts_hd_ma", "flac", "alac", "wavpack", "monkeys_audio", "pcm", "dsd", "wma_lossless"]
HIGH_RATE = ["truehd", "dts_hd_ma", "dts_x", "dts_hd_hra"]
OBJECTS = ["truehd", "dts_hd_ma", "dts_x", "eac3", "ac4"]
CORE = {"dts_hd_ma": "dts", "dts_x": "dts", "dts_hd_hra": "dts", "truehd": "ac3"}
BITMAP = ["pgs", "vobsub", "dvbsub"]
CAPTIONS = ["cea608", "cea708", "teletext"]
STYLED = ["ass", "ttml"]
HDR10_BASE = ["hdr10", "hdr10_plus", "dolby_vision_p8", "dolby_vision_p7_mel", "dolby_vision_p7_fel"]
# What containers carry. Matroska carries everything; a leading "-" lists what a container refuses, "other" the codecs without a name.
CARRIES_VIDEO = {
    "webm": "vp8 vp9 av1", "mp4": "- vc1 uncompressed other", "fragmented_mp4": "- vc1 uncompressed other", "mpeg_ts": "h264 hevc mpeg1 mpeg2 vc1 vvc", "mpeg_ps": "mpeg1 mpeg2 h264",
    "avi": "- hevc av1 vvc prores_raw", "asf": "mpeg4 vc1 other", "flv": "h264", "ogg": "theora vp8",
}
CARRIES_AUDIO = {
    "webm": "opus vorbis", "mp4": "- dsd monkeys_audio wavpack other", "fragmented_mp4": "- dsd monkeys_audio wavpack other", "mpeg_ts": "aac ac3 eac3 ac4 dts dts_hd_ma mp2 mp3 truehd",
    "mpeg_ps": "ac3 dts mp2 pcm", "avi": "mp3 ac3 dts pcm aac", "asf": "wma mp3 other", "flv": "aac mp3", "ogg": "vorbis opus flac",
}
CARRIES_SUBTITLE = {"webm": "webvtt", "mp4": "webvtt ttml subrip", "fragmented_mp4": "webvtt ttml subrip", "mpeg_ts": "dvbsub pgs", "mpeg_ps": "vobsub"}
REMUX_ORDER = ["matroska", "fragmented_mp4", "mp4", "mpeg_ts", "webm"]
GAMUT_RANK = {"bt2020": 3, "dci_p3": 2, "display_p3": 2}


def _carries(container: Column, codec: Column, table: dict[str, str]) -> Column:
    out = F.when(container == "matroska", True)
    for name, text in table.items():
        listed = codec.isin(*text.removeprefix("- ").split())
        out = out.when(container == name, ~listed if text.startswith("-") else listed)
    return out.otherwise(False)


def carriers(codec: str | None, table: dict[str, str]) -> list[str]:
    """The containers of a table, and Matroska, that carry a codec ("other" for one without a name); all of them for None."""
    def listed(text: str) -> bool:
        return (codec in text.removeprefix("- ").split()) != text.startswith("-")

    return ["matroska", *(name for name, text in table.items() if codec is None or listed(text))]


def carries_video(container: Column, codec: Column) -> Column:
    """P12. A null codec (no such stream) fits everywhere."""
    return codec.isNull() | _carries(container, F.when(codec.isin(*VIDEO), codec).otherwise("other"), CARRIES_VIDEO)


def carries_audio(container: Column, codec: Column) -> Column:
    """P12. A null codec (no such stream) fits everywhere."""
    return codec.isNull() | _carries(container, F.when(codec.isin(*AUDIO), codec).otherwise("other"), CARRIES_AUDIO)


def carries_subtitle(container: Column, codec: Column) -> Column:
    """P12. Captions live in the picture's stream, so they go wherever H.264 does."""
    return F.when(codec.isin(*CAPTIONS), carries_video(container, F.lit("h264"))).otherwise(_carries(container, codec, CARRIES_SUBTITLE))


def core_of(codec: Column) -> Column:
    """The codec of the core that can be cut out of a stream, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CORE.items() for x in pair)), codec)


def remux_rank(container: Column) -> Column:
    """Lower is better."""
    out = F.when(container == REMUX_ORDER[0], 0)
    for k, name in enumerate(REMUX_ORDER[1:], 1):
        out = out.when(container == name, k)
    return out.otherwise(250)


def gamut_rank(primaries: Column) -> Column:
    out = F.when(primaries == "bt2020", 3)
    for name in ("dci_p3", "display_p3"):
        out = out.when(primaries == name, GAMUT_RANK[name])
    return out.otherwise(1)


def shows_hdr(formats: Column, hdr: Column) -> Column:
    """A display shows plain pictures, the formats it lists, and formats with an HDR10 base if it lists HDR10."""
    return (hdr == "sdr") | F.array_contains(formats, hdr) | (hdr.isin(*HDR10_BASE) & F.array_contains(formats, "hdr10"))
