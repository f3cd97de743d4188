"""Playback decisions on single sources, worked out by hand, and on odd input."""

import pytest

from reelspark.operators import ladders
from reelspark.plans.ladders import CLIENTS

SOURCE = "source_id long, client string, container string, bitrate_bps long, recovered_lossy boolean, codec string, profile string, level int, width int, height int, bit_depth int, chroma string, hdr string, gamut string, video_bitrate_bps long, interlaced boolean"
AUDIO = "source_id long, idx int, codec string, channels int, sample_rate int, has_objects boolean, language string, commentary boolean, visual_impaired boolean, original boolean, is_default boolean, bitrate_bps long"
TEXT = "source_id long, idx int, codec string, language string, forced boolean, hearing_impaired boolean, is_default boolean, external boolean"


def track(source, idx, codec, channels=2, language="en", rate=48000, **other):
    return {"source_id": source, "idx": idx, "codec": codec, "channels": channels, "sample_rate": rate, "language": language} | other


def video(source, client, container="matroska", codec="h264", **other):
    return {"source_id": source, "client": client, "container": container, "codec": codec, "width": 1920, "height": 1080, "bit_depth": 8, "chroma": "420", "hdr": "sdr", "gamut": "bt709"} | other


@pytest.fixture
def plan(spark):
    def run(sources, audio=(), texts=(), **wanted):
        frames = [spark.createDataFrame([{n.split()[0]: None for n in schema.split(", ")} | r for r in rows], schema) for rows, schema in ((sources, SOURCE), (audio, AUDIO), (texts, TEXT))]
        clients = spark.createDataFrame(CLIENTS, ladders.CLIENT)
        chosen = ladders.select_tracks(*frames, clients, ["en"], ["en"], **wanted)
        return {(r["source_id"], r["client"]): r for r in ladders.playback_plan(chosen, clients).collect()}, chosen

    return run


def test_a_hdr_remux_is_untouched_natively_and_never_in_a_browser(plan):
    got, _ = plan([video(1, c, codec="hevc", width=3840, height=2160, bit_depth=10, hdr="hdr10", gamut="dci_p3", bitrate_bps=60_000_000) for c in ("native", "browser", "purist")], [track(1, 1, "truehd", 8)])
    native, browser = got[1, "native"], got[1, "browser"]
    assert (native["tier"], native["delivery"]["kind"], native["audio_path"]["kind"], native["reasons"]) == (0, "original", "passthrough", [])
    assert (browser["tier"], browser["video_path"]["codec"], browser["delivery"]["container"]) == (3, "av1", "fragmented_mp4")
    assert [r["reason"] for r in browser["reasons"]] == ["VideoCodecUnsupported", "NetworkHeadroom", "HdrUnsupportedByDisplay", "GamutUnsupportedByDisplay", "SinkLacksEncoding", "ChannelCountUnsupported", "ContainerUnsupported"]
    assert browser["video_path"]["bitrate_bps"] == 40_000_000 and browser["audio_path"]["channels"] == 2
    assert got[1, "purist"]["tier"] == 0


def test_policies_block_and_keep_their_reasons(plan):
    got, _ = plan([video(1, "purist", "mp4"), video(2, "television", "mp4", "vp9"), video(3, "native", recovered_lossy=True), video(4, "native", codec=None)], [track(1, 1, "ac3"), track(2, 1, "aac"), track(3, 1, "ac3")])
    assert (got[1, "purist"]["tier"], [r["reason"] for r in got[1, "purist"]["reasons"]]) == (5, ["ContainerUnsupported", "UserPolicy"])
    assert got[2, "television"]["tier"] == 5 and got[2, "television"]["reasons"][-1]["reason"] == "UserPolicy"
    assert (got[3, "native"]["tier"], got[3, "native"]["reasons"][0]["reason"]) == (4, "SourceIncomplete")
    assert (got[4, "native"]["tier"], got[4, "native"]["reasons"][0]["reason"]) == (5, "ContainerUnsupported")


def test_audio_ladder(plan):
    tracks = [track(1, 1, "flac", 2), track(2, 1, "opus", 2, rate=22050), track(3, 1, "dts_hd_ma", 8), track(4, 1, "aac", 8), track(5, 1, "eac3", 2, has_objects=True)]
    got, _ = plan([video(k, "native") for k in (1, 2)] + [video(k, "television", "mp4") for k in (3, 4, 5)], tracks)
    kinds = {k[0]: (r["audio_path"]["kind"], r["audio_path"]["codec"], r["audio_path"]["channels"], r["audio_path"]["sample_rate"], r["tier"]) for k, r in got.items()}
    assert kinds == {1: ("bit_perfect", None, None, None, 0), 2: ("lpcm", None, 2, 44100, 2), 3: ("core", "dts", None, None, 2), 4: ("transcode", "ac3", 6, None, 3), 5: ("lpcm", None, 2, 48000, 2)}


def test_subtitles(plan):
    sources = [video(1, "browser", "fragmented_mp4"), video(2, "browser", "fragmented_mp4"), video(3, "native"), video(4, "native", "mp4")]
    texts = [{"source_id": k, "idx": 9, "codec": c, "language": "en", "external": x} for k, c, x in ((1, "pgs", False), (2, "ass", False), (3, "pgs", False), (4, "ass", True))]
    got, _ = plan(sources, [track(k, 1, "aac", language="ja") for k in (1, 2, 3, 4)], texts)
    assert {k[0]: tuple(r["subtitle_path"]) for k, r in got.items()} == {1: ("burned_in", None), 2: ("out_of_band", "webvtt"), 3: ("in_band", None), 4: ("out_of_band", "ass")}
    assert got[1, "browser"]["video_path"]["burn_in"] and got[1, "browser"]["tier"] == 3


def test_forced_tracks_ties_and_odd_rows(plan, spark):
    audio = [track(1, 1, "aac"), track(1, 2, "aac"), track(1, 3, "aac", commentary=True), track(None, 1, "aac"), track(2, 5, None, None, None, None)]
    texts = [{"source_id": 1, "idx": 7, "codec": "subrip", "language": "eng", "forced": True}, {"source_id": 1, "idx": 8, "codec": "subrip", "language": "en"}, {"source_id": 2, "idx": 4, "codec": None, "language": None}]
    sources = [video(1, "native"), video(1, "native"), video(2, "native"), video(None, "native"), video(1, None), video(1, "unknown"), {"source_id": 3, "client": "browser"}]
    got, chosen = plan(sources, audio, texts)
    picks = {(r["source_id"], r["client"]): (r["audio"] and r["audio"]["idx"], r["subtitle"] and r["subtitle"]["idx"]) for r in chosen.collect()}
    assert picks[1, "native"] == (2, 7) and picks[2, "native"] == (5, None) and picks[None, "native"] == (None, None) and chosen.count() == 7
    assert got[3, "browser"]["tier"] == 5 and (1, "unknown") not in got and len(got) == 4
    assert plan(sources, audio, texts, forced_audio=3, forced_subtitle=99)[1].filter("source_id = 1 AND client = 'native' AND audio.idx = 3 AND subtitle IS NULL").count() == 2
    assert plan(sources, audio, texts, forced_audio=99)[1].filter("audio.idx = 2").count() == 2
    assert plan([], [], [])[0] == {}


def test_a_row_searches_no_list_of_its_client(spark, plan):
    """Containers and decoders are looked up: only the choice of a sample rate still walks a list."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        clients = spark.createDataFrame(CLIENTS, ladders.CLIENT)
        chosen = plan([video(1, "native")], [track(1, 1, "aac")])[1]
        shown = ladders.playback_plan(chosen, clients)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    above = shown[: shown.index("BroadcastHashJoin")]
    assert "filter(" not in above and "array_min(" not in above and "exists(" not in above


def test_containers_that_repeat_or_that_nobody_knows(plan, spark, monkeypatch):
    client = CLIENTS[0] | {"client": "odd", "containers": ["what", "avi", "avi", None, "mpeg_ts", "else", "ogg", "mp4"], "decoders": [*CLIENTS[0]["decoders"][:1], CLIENTS[0]["decoders"][0] | {"max_width": 1}]}
    nothing = CLIENTS[0] | {"client": "none", "containers": ["what"]}
    monkeypatch.setattr("tests.test_ladders.CLIENTS", [client, nothing])
    got, _ = plan([video(1, "odd"), video(2, "odd", codec="theora"), video(3, "odd", codec="ffv1"), video(4, "none"), video(5, "odd", codec="vc1", width=9000)], [track(1, 1, "aac"), track(2, 1, "vorbis"), track(3, 1, "pcm"), track(4, 1, "aac"), track(5, 1, "dsd")])
    assert {k[0]: tuple(r["delivery"]) for k, r in got.items()} == {1: ("remux", "mp4"), 2: ("remux", "mp4"), 3: ("remux", "mp4"), 4: ("original", "matroska"), 5: ("remux", "mp4")}
    assert got[4, "none"]["tier"] == 5 and got[5, "odd"]["video_path"]["width"] == 4096


def test_tasks_that_choose_tracks_grow_in_number_and_not_in_size(plan, monkeypatch):
    monkeypatch.setattr(ladders, "REQUESTS_A_TASK", 2)
    rows = [video(k, "native") for k in range(20)]
    _, chosen = plan(rows, [track(k, 1, "aac") for k in range(20)])
    assert chosen.rdd.getNumPartitions() == 11 and chosen.filter("audio.idx = 1").count() == 20
