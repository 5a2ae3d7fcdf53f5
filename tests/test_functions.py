"""Boundary cases of the column functions."""

import datetime as dt
import fnmatch
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetlake import config, rules
from assetlake.functions import dates, fmt, ids, media, paths
from assetlake.operators import categorize, detect


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def test_extensions_as_the_operating_system_sees_them(spark):
    names = ["a.jpg", "a.tar.gz", ".hidden", "..x", ".a.b", "a.", "a", "", "dir.d/file", "dir/.x.Y", "ünï.JPG", "a\nb.c"]
    got = values(spark, [(n,) for n in names], "p string", paths.extension(F.col("p")), paths.stem(F.col("p")))
    assert got == [(os.path.splitext(n)[1], os.path.splitext(os.path.basename(n))[0]) for n in names]


def test_null_paths_stay_null_or_false(spark):
    p = F.col("p")
    row = spark.createDataFrame([(None, None)], "p string, n bigint").select(paths.extension(p), paths.sanitize(p), paths.reject_reason(p, F.col("n")), rules.any_glob(p, ["*"]), paths.file_type_of(p)).first()
    assert tuple(row) == (None, None, None, False, "unknown")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.*?[]!-^\\_1 ", max_size=7), st.text(alphabet="ab.*?[]!-^\\_1 \n", max_size=7))
def test_globs_match_like_the_shell(pattern, name):
    import re

    java = rules.glob_to_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.search(java, name)) == fnmatch.fnmatchcase(name, pattern)


def test_sanitize(spark):
    got = values(spark, [('a<b>:"c.txt',), ("  .. x. ",), ("...",), ("",), (None,)], "p string", paths.sanitize(F.col("p")))
    assert [g[0] for g in got] == ["a_b___c.txt", " x", "unnamed", "unnamed", None]


@pytest.mark.parametrize(
    ("text", "date", "sure"),
    [
        ("IMG_20240315_143000", dt.datetime(2024, 3, 15, 14, 30), 0.8), ("2024-02-30", None, None), ("2024-13-01", None, None), ("32-01-2024", None, None),
        ("1899-01-01", None, None), ("2101-01-01", None, None), ("05-03-2024", dt.datetime(2024, 3, 5), 0.4), ("25-03-2024", dt.datetime(2024, 3, 25), 0.8),
        ("20240315_trip", None, None), ("2024_01_02 03.04.05", dt.datetime(2024, 1, 2, 3, 4, 5), 0.8), ("", None, None), (None, None, None),
    ],
)
def test_dates_in_names(spark, text, date, sure):
    r = dates.name_date(F.col("t"), 0.8)
    assert values(spark, [(text,)], "t string", r["date"], r["confidence"]) == [(date, sure)]


def test_date_tiers(spark):
    meta = dt.datetime(2020, 1, 1)
    rows = [(meta, "/2021-01-01/2022-01-01.jpg"), (None, "/2021-01-01/2022-01-01.jpg"), (None, "/2021-01-01/x.jpg"), (None, "/a/x.jpg")]
    r = dates.date_result(F.col("m"), F.col("p"), F.when(F.col("p") == "/a/x.jpg", F.lit("2019-01-01").cast("timestamp_ntz")))
    assert values(spark, rows, "m timestamp_ntz, p string", r["source"], r["confidence"]) == [("metadata", 1.0), ("parsed", 0.8), ("parsed", 0.6), ("inferred", 0.3)]


def test_metadata_dates(spark):
    rows = ["2024:03:15 14:30:00", "2024:03:15 14:30", "2024-03-15T14:30:00", "0000:00:00 00:00:00", "2024:02:30 00:00:00", "", "x", None]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "t string", dates.exif_date(F.col("t")))]
    assert got == [dt.datetime(2024, 3, 15, 14, 30)] * 3 + [None] * 5
    assert values(spark, [("2024:03:15 14:30:00.25+02:00",)], "t string", dates.tool_date(F.col("t"))) == [(dt.datetime(2024, 3, 15, 14, 30),)]


def test_hashes_and_ids_by_value(spark):
    got = values(spark, [(" SHA256:AB ",), ("0xab",), ("ab",), ("",), (None,)], "h string", ids.norm_hash("h"))
    assert [g[0] for g in got] == ["ab", "ab", "ab", None, None]
    bits = values(spark, [("0xFF",), ("ff",), ("ffffffffffffffff",), ("8000000000000000",), ("",), ("xyz",), ("1" * 17,), (None,)], "h string", ids.phash_bits("h"))
    assert [b[0] for b in bits] == [255, 255, -1, -(2**63), None, None, None, None]


def test_media(spark):
    rows = [("Canon", "Canon EOS"), ("SONY", "A7"), (None, "Pixel"), ("X ", None), (None, None), ("", "")]
    assert values(spark, rows, "a string, b string", media.make_model_label(F.col("a"), F.col("b")), media.camera_key(F.col("a"), F.col("b"))) == [
        ("Canon EOS", "Canon EOS"), ("SONY - A7", "SONY - A7"), ("Pixel", "Pixel"), ("X", "X"), (None, None), ("unnamed", None)]
    sizes = [(1920, 1080), (16, 9), (39, 18), (1000, 777), (0, 0), (None, 5)]
    assert [r[0] for r in values(spark, sizes, "w int, h int", media.display_ratio(F.col("w"), F.col("h")))] == [True, True, True, False, False, False]
    f = media.fit_within(F.col("w"), F.col("h"), 3840, 2160)
    assert values(spark, [(8000, 1000), (100, 100), (3840, 4320)], "w int, h int", f["w"], f["h"]) == [(3840, 480), (100, 100), (1920, 2160)]
    assert [r[0] for r in values(spark, [("2020-01",), ("1899",), ("abc",), (None,)], "t string", media.year_tag(F.col("t")))] == [2020, None, None, None]


def test_figures(spark):
    assert [r[0] for r in values(spark, [(0,), (1023,), (1536,), (5 * 1024**4,)], "n bigint", fmt.fmt_bytes(F.col("n")))] == ["0 B", "1023 B", "1.5 KB", "5.0 TB"]
    assert [r[0] for r in values(spark, [(45.9,), (185.0,), (7380.0,)], "s double", fmt.fmt_duration(F.col("s")))] == ["45s", "3m 5s", "2h 3m"]
    assert [r[0] for r in values(spark, [(0.71,), (0.7,), (0.2,)], "c double", fmt.confidence_bucket(F.col("c")))] == ["high", "medium", "low"]


def test_content_types(spark):
    rows = [
        ("a.bin", b"RIFF0000WEBP"), ("a.avi", b"RIFF0000XXXX"), ("a.mp4", b"0000ftypisom"), ("a.m4a", b"0000ftypisom"), ("a.mp4", b"0000ftypzzzz"),
        ("a.heic", b"0000ftypheic"), ("a.txt", b"\xff\xd8\xff\xe0"), ("a.pdf", b""), ("a.pdf", None), ("a.zzz", b"hello"), ("a.mp4", b"0000ftyp"),
    ]
    t = detect.content_type(F.col("p"), F.col("h"))
    assert [r[0] for r in values(spark, rows, "p string, h binary", t["mime"])] == [
        "image/webp", "video/x-msvideo", "video/mp4", "audio/mp4", "video/mp4", "image/heic", "image/jpeg", "application/pdf", "application/pdf", "application/octet-stream", "video/mp4",
    ]


def test_category_priorities(spark):
    c = F.col
    image = categorize.image_category(c("p"), c("software"), c("make"), c("gps"), c("w"), c("h"), c("dated"))
    rows = [
        ("a.CR2", "GIMP", "X", False, 1, 1, True, "RAW"), ("a.jpg", "GIMP 2", "X", False, 1, 1, True, "Edited"), ("a.jpg", "Picasa 3", None, False, None, None, False, "Collection"),
        ("Screenshot_1.png", None, "X", False, 1, 1, True, "Screenshots"), ("IMG-1-WA2.jpg", None, "X", False, 1, 1, True, "Social Media"),
        ("a.jpg", None, None, False, 1085, 1915, False, "Screenshots"), ("a.jpg", None, None, True, 1085, 1915, True, "Export"), ("a.jpg", None, "X", False, 1080, 1920, True, "Originals"),
        ("a.jpg", None, None, None, None, None, True, "Export"), ("screenshot_1.png", None, None, False, 7, 5, False, "Collection"),
    ]
    got = values(spark, rows, "p string, software string, make string, gps boolean, w int, h int, dated boolean, want string", image, c("want"))
    assert [g[0] for g in got] == [g[1] for g in got]
    video = categorize.video_category(c("p"), c("s"), c("u"), c("make"), F.lit(None).cast("string"), c("loc"))
    rows = [("MOTION_1.mp4", 9.9, False, "X", False, "Motion Photos"), ("MOTION_1.mp4", 9.9, True, None, False, "Clips"), ("a.3gp", 1.0, False, None, False, "Mobile"), ("a.mts", 1000.0, False, None, False, "Camcorder"), ("a.mp4", 900.0, False, None, False, "Clips"), ("a.mp4", 900.1, False, None, None, "Movies")]
    got = values(spark, rows, "p string, s double, u boolean, make string, loc boolean, want string", video, c("want"))
    assert [g[0] for g in got] == [g[1] for g in got]


def test_configuration_layers(tmp_path):
    user = tmp_path / "user.json"
    user.write_text('{"threads": 8, "editor_exclusions": []}')
    c = config.resolve(str(user), {"jpeg_quality": 70})
    assert (c.threads, c.jpeg_quality, c.editor_exclusions) == (8, 70, ())
    assert config.changed(c) == {"threads": 8, "jpeg_quality": 70, "editor_exclusions": ()}
    for bad, error in (({"threads": 17}, ValueError), ({"nope": 1}, KeyError), ({"threads": "4"}, TypeError)):
        with pytest.raises(error):
            config.resolve(None, bad)
