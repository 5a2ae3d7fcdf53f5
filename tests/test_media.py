"""Parsers of contents and of what tools print, and the small functions beside them."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake import config
from assetlake.functions import media as fm
from assetlake.operators import grouping, review
from assetlake.plans import reports
from assetlake.sources import media, sinks


def tiff(entries, order="<", sub=(), gps=()):
    """A TIFF of directories of (tag, type, count, packed bytes)."""
    body, heads = b"", {}

    def directory(rows, at):
        head, data = struct.pack(order + "H", len(rows)), b""
        free = at + 2 + 12 * len(rows) + 4
        for tag, kind, n, raw in rows:
            if len(raw) <= 4:
                head += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                head += struct.pack(order + "HHII", tag, kind, n, free + len(data))
                data += raw
        return head + struct.pack(order + "I", 0) + data

    main = list(entries) + [(0x8769, 4, 1, b"\0" * 4)] * bool(sub) + [(0x8825, 4, 1, b"\0" * 4)] * bool(gps)
    size = len(directory(main, 8))
    for tag, rows in ((0x8769, sub), (0x8825, gps)):
        if rows:
            heads[tag] = 8 + size + len(body)
            body += directory(rows, heads[tag])
    main = [(t, k, n, struct.pack(order + "I", heads[t]) if t in heads else raw) for t, k, n, raw in main]
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + directory(main, 8) + body


def text(tag, value):
    raw = value.encode() + b"\0"
    return (tag, 2, len(raw), raw)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("jpeg", [False, True])
def test_exif_of_bytes(order, jpeg):
    third = lambda *p: struct.pack(order + "6I", *p)
    data = tiff(
        [text(0x010F, "Canon "), text(0x0110, "EOS"), (0x0112, 3, 1, struct.pack(order + "H", 6))], order, [text(0x9003, "2024:03:15 12:00:00"), text(0x9011, "+02:00")],
        [(1, 2, 2, b"S\0"), (2, 5, 3, third(10, 1, 30, 1, 36, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, third(20, 1, 0, 1, 0, 0))],
    )
    if jpeg:
        data = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xda"
    got = media.parse_exif(data)
    assert (got["status"], got["make"], got["model"], got["orientation"], got["original"], got["offset"]) == ("ok", "Canon", "EOS", 6, "2024:03:15 12:00:00", "+02:00")
    assert got["gps_lat"] == pytest.approx(-10.51) and got["gps_lon"] == 20.0


def test_exif_of_what_is_none(spark):
    whole = tiff([text(0x0131, "Some editor")])
    assert media.parse_exif(whole)["status"] == "partial" and media.parse_exif(b"\xff\xd8\xff\xda")["status"] == "none" and media.parse_exif(b"plain text")["status"] == "none"
    for bad in (None, b"", whole[:20], b"II*\0\xff\xff\xff\x7f"):
        assert media.parse_exif(bad)["status"] == "error"
    d = spark.createDataFrame([(bytearray(whole),), (None,)], "content binary")
    assert [r.e.status for r in d.select(media.exif_metadata("content").alias("e")).collect()] == ["partial", "error"]


def test_perceptual_hash_holds_under_scaling(spark):
    rng = np.random.default_rng(0)
    small = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))
    large = np.kron(small, np.ones((2, 2)))
    a, b, c = media._phash(small.reshape(-1), 128), media._phash(large.reshape(-1), 256), media._phash(rng.integers(0, 255, 4096), 64)
    assert a == b and len(a) == 16 and bin(int(a, 16) ^ int(c, 16)).count("1") > 10
    assert media._phash([], 3) is None and media._phash([1, 2, 3], 2) is None and media._phash([5], 1) is not None
    d = spark.createDataFrame([([1, 2, 3, 4], 2), (None, 2), ([1], None)], "p array<int>, w int")
    assert [r[0] is None for r in d.select(media.perceptual_hash("p", "w")).collect()] == [False, True, True]


def test_prober_reads_the_first_video_stream(spark):
    docs = [
        {"format": {"duration": "3.14159", "tags": {"com.apple.quicktime.location": "x", "date": "2024-03-15"}}, "streams": [{"codec_type": "audio", "tags": {"make": "no"}}, {"codec_type": "video", "width": 10, "height": 20, "tags": {"make": "GoPro", "encoder": " x "}}]},
        {"format": {"tags": {"make": "Lavf58", "model": "m", "creation_time": "2024-03-15T12:00:00.500000Z", "location-eng": "x"}}}, {"format": {"tags": {"com.android.manufacturer": "A", "creation_time": "2024-03-15 12:00:00"}}}, {},
    ]
    d = spark.createDataFrame([(json.dumps(x),) for x in docs] + [(None,), ("{",)], "j string").select(media.probe_metadata(F.col("j")).alias("m")).select("m.*").collect()
    assert (d[0].make, d[0].width, d[0].has_location, d[0].duration_seconds, str(d[0].date), d[0].encoder) == ("GoPro", 10, True, 3.142, "2024-03-15 00:00:00", "x")
    assert (d[1].make, d[1].model, d[1].has_location, str(d[1].date), d[1].duration_unknown) == (None, None, False, "2024-03-15 12:00:00.500000", True)
    assert d[2].make == "A" and d[3].make is None and d[4].make is None and d[5].make is None


def test_tool_tags_and_tiers(spark):
    docs = [{"Make": "x264", "Model": "m", "Duration": 2.5, "TrackCreateDate": "2024:03:15 12:00:00", "GPSLatitude": 1.0}, {"Make": " Sony ", "DateTimeOriginal": "2024:03:15 12:00:00", "ImageWidth": 4, "ModifyDate": "2023:01:01 00:00:00"}]
    d = spark.createDataFrame([(json.dumps(x),) for x in docs], "j string")
    v = d.select(media.tool_video(F.col("j")).alias("m")).select("m.*").collect()
    assert (v[0].make, v[0].model, v[0].duration_seconds, v[0].has_location, str(v[0].date)) == (None, None, 2.5, True, "2024-03-15 12:00:00") and v[1].width is None and v[1].duration_unknown
    e = d.select(media.tool_metadata(F.col("j")).alias("m")).select("m.*").collect()
    assert e[1].status == "ok" and e[1].make == "Sony" and e[0].status == "partial"
    low, high = (F.struct(F.lit(s).alias("status")) for s in ("partial", "ok"))
    r = spark.range(1).select(media.best_exif(low, high)["status"], media.best_exif(high, low)["status"], media.best_exif(low, low)["status"]).first()
    assert tuple(r) == ("ok", "ok", "partial")
    t = d.select(media.tool_video(F.col("j")).alias("m")).select(media.first_known(F.col("m"), F.col("m"))["duration_unknown"].alias("u")).collect()
    assert [x.u for x in t] == [False, True]


def test_tags_count_without_genre_and_year(spark):
    d = spark.createDataFrame([("id3", {"TCON": "Rock", "TDRC": "1999"}), ("id3", {"TPE1": "A"}), ("ape", {}), (None, None)], "c string, t map<string,string>")
    assert [r.x.has_tags for r in d.select(media.audio_tags(F.col("c"), F.col("t"), F.lit("stem")).alias("x")).collect()] == [False, True, False, False]


def test_picks_of_tags(spark):
    d = spark.createDataFrame([([("a", 1), ("b", 3), ("", 9), ("c", 3), (None, 8)], [None, "", "x", "y"], ["?", "1850", "1999-01-02", "2001"]), ([], [], [])], "t array<struct<name:string,count:int>>, n array<string>, d array<string>")
    items = F.transform("n", lambda x: F.struct(x.alias("title")))
    got = [tuple(r) for r in d.select(fm.top_tag(F.col("t")), fm.first_named(items, "title"), fm.first_year(F.col("d"))).collect()]
    assert got == [("b", "x", 1999), (None, None, None)]


def test_sidecars_keep_what_follows(spark):
    cars = spark.createDataFrame([("/d/V.MP4", "/d/v.mp4_en.srt"), ("/d/V.MP4", "/d/V.srt"), ("/d/w.mov", "/d/w.srt")], "video_path string, sidecar_path string")
    to = spark.createDataFrame([("/d/V.MP4", "/l/2024 -- V.MP4"), ("/d/w.mov", None)], "video_path string, destination_path string")
    assert sorted(r.destination_path for r in grouping.sidecar_copies(cars, to).collect()) == ["/l/2024 -- V.MP4_en.srt", "/l/2024 -- V.srt"]
    files = spark.createDataFrame([("/d/v.mp4",), ("/d/v.mp4_en.srt",), ("/d/v.srt",), ("/d/v_en.srt",)], "source_path string")
    assert sorted(r.sidecar_path for r in grouping.sidecars(files).collect()) == ["/d/v.mp4_en.srt", "/d/v.srt"]


def test_reclassified_and_unknown(spark):
    r = spark.createDataFrame([("a", "Collection", "/old"), ("b", "X", "/b")], "file_id string, category string, destination_path string")
    c = spark.createDataFrame([("a", "Export"), ("q", "Export"), ("b", None)], "file_id string, category string")
    assert sorted(map(tuple, review.reclassified(r, c, F.concat(F.lit("/"), "category")).collect())) == [("a", "Export", "/Export"), ("b", "X", "/b")]
    assert [x.file_id for x in review.unknown_ids(r, c).collect()] == ["q"]


def test_warnings_at_their_thresholds(spark):
    cols = "total_files int, files_to_copy int, duplicates_found int, inferred_dates int, shortfall_bytes bigint, cloud_stubs int, unresolved_pairs int"
    of = lambda *v: [r.n for r in reports.preview_warnings(spark.createDataFrame([v], cols)).orderBy("n").collect()]
    assert of(4, 4, 2, 1, 0, 0, 0) == [] and of(4, 3, 3, 1, 1, 1, 1) == [0, 1, 2, 3, 4] and of(0, 0, 0, 0, 0, 0, 0) == []


def test_copies_compared_and_locks(spark, tmp_path):
    for n, t in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "xx")):
        (tmp_path / n).write_text(t)
    rows = [(str(tmp_path / "a"), str(tmp_path / n)) for n in "bcde"]
    got = sinks.compared(spark.createDataFrame(rows, "source_path string, destination_path string")).collect()
    assert [r.same for r in got] == [True, False, False, False] and got[3].error
    lock = str(tmp_path / "lock")
    with sinks.WriterLock(lock):
        with pytest.raises(RuntimeError), sinks.WriterLock(lock):
            pass
    (tmp_path / "lock").write_text("999999999")
    with sinks.WriterLock(lock):
        pass


def test_settings_as_typed():
    assert [config.parse_value(x) for x in ("yes", "OFF", "12", '["a"]', "plain")] == [True, False, 12, ["a"], "plain"]
    c = config.added(config.Config(), "editor_patterns", "Krita")
    assert "Krita" in c.editor_patterns and config.added(c, "editor_patterns", "Krita") is c
    assert config.removed(c, "editor_patterns", "Krita") == config.Config() == config.reset(c) == config.reset(c, "editor_patterns")
    for wrong in (lambda: config.added(c, "threads", 1), lambda: config.removed(c, "editor_patterns", "none")):
        with pytest.raises((TypeError, ValueError)):
            wrong()

