"""Listing, copies, tables, media parsers and the stream."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from assetlake.functions import paths
from assetlake.sources import listing, media, sinks, store
from assetlake.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.jpg": b"\xff\xd8\xff", "_under.txt": b"x", ".hidden": b"x", "sub/b é%20.mp4": b"0000ftypisom", "sub/deep/c.tmp": b"", ".git/config": b"x", "sub/node_modules/d.js": b"x"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(tmp_path / "root" / "a.jpg", tmp_path / "root" / "link.jpg")
    return tmp_path


def test_listing_sees_every_name(spark, tree):
    listing.register(spark)
    d = spark.read.format("listing").option("roots", str(tree / "root")).option("hash", "true").load()
    got = {os.path.relpath(r.source_path, tree / "root"): r for r in d.collect()}
    assert set(got) == {"a.jpg", "_under.txt", ".hidden", "sub/b é%20.mp4", "sub/deep/c.tmp", ".git/config", "sub/node_modules/d.js", "link.jpg"}
    assert got["a.jpg"].sha256_hash == d.select(F.sha2(F.lit(b"\xff\xd8\xff"), 256)).first()[0] and got["link.jpg"].is_symlink and got["sub/deep/c.tmp"].file_size == 0
    kept = spark.read.format("listing").option("roots", str(tree / "root")).option("skipDirs", ".git,node_modules").load()
    rel = F.expr(f"substring(source_path, {len(str(tree / 'root')) + 1})")
    left = kept.where("not is_symlink").where(paths.reject_reason(rel, F.col("file_size")).isNull())
    assert {os.path.basename(r.source_path) for r in left.collect()} == {"a.jpg", "_under.txt", "b é%20.mp4"}
    missing = spark.read.format("listing").option("roots", str(tree / "nowhere")).load().collect()
    assert len(missing) == 1 and missing[0].error


def test_copies_can_be_repeated(spark, tree):
    src, dst = str(tree / "root/a.jpg"), str(tree / "out/x/a.jpg")
    plan = spark.createDataFrame([(src, dst), (str(tree / "no"), str(tree / "out/no")), (src, None)], "source_path string, destination_path string")
    for _ in range(2):
        got = {r.source_path: r.copied for r in sinks.copied(plan).collect()}
        assert got == {src: True, str(tree / "no"): False}
    assert os.listdir(tree / "out/x") == ["a.jpg"] and os.path.getmtime(dst) == os.path.getmtime(src)
    assert all(r.removed for r in sinks.deleted(plan.where("destination_path like '%a.jpg'")).collect()) and not os.path.exists(dst)
    assert sinks.remove_empty_parents([str(tree / "out/x")], str(tree)) == 2


def test_exports_and_plan(spark, tmp_path):
    f = spark.createDataFrame([(1, "Originals", "/d/a", "/e/a"), (2, "Clips", "/d/b", "/e/b"), (3, "RAW", None, "/e/c")], "file_id int, category string, destination_path string, export_path string")
    assert sorted(tuple(r) for r in sinks.sink_plan(f).collect()) == [(1, "export", "/e/a"), (1, "file", "/d/a"), (2, "file", "/d/b")]
    p = spark.createDataFrame([(3, 5)], "total_files int, files_to_copy int")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "category string, files bigint")
    rows = sinks.summary_rows(p, b, b.withColumnRenamed("category", "reason"))
    assert [r.key for r in rows.collect()] == ["files_to_copy", "total_files", "y", "x", "y", "x"]
    sinks.export(rows, f"{tmp_path}/out", "csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 6


def test_store(spark, tmp_path):
    root = str(tmp_path)
    assert store.read(spark, root, "hashes").count() == 0
    rows = spark.createDataFrame([(1, "s", "/", "/a", 1, 1.0), (2, "s", "/", "/a", 2, 1.0)], store.SCHEMAS["source_manifest"])
    store.append(rows, root, "source_manifest")
    store.append(rows.where("id = 1").withColumn("session_id", F.lit("t")), root, "source_manifest")
    got = store.latest(store.read(spark, root, "source_manifest"), ["session_id", "file_path"], ["id"])
    assert sorted((r.session_id, r.file_size) for r in got.collect()) == [("s", 2), ("t", 1)]


def atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_mp4_atoms(spark):
    mvhd = atom(b"mvhd", struct.pack(">4xIIII", 2082844800 + 100, 0, 600, 900) + bytes(80))
    tkhd = atom(b"tkhd", bytes(76) + struct.pack(">II", 1920 << 16, 1080 << 16))
    udta = atom(b"udta", atom(b"\xa9mak", struct.pack(">HH", 5, 0) + b"Canon") + atom(b"\xa9mod", struct.pack(">HH", 2, 0) + b"R5"))
    film = atom(b"ftyp", b"isom0000") + atom(b"moov", mvhd + atom(b"trak", tkhd) + udta)
    rows = spark.createDataFrame([(bytearray(film),), (bytearray(film[:60]),), (bytearray(b""),), (None,)], "c binary").coalesce(1).select(media.mp4_metadata("c").alias("m")).select("m.*").collect()
    assert tuple(rows[0]) == (1.5, 100, 1920, 1080, "Canon", "R5", False)
    assert all(r.duration_unknown and r.make is None for r in rows[1:])


def test_printed_metadata(spark):
    probe = '{"format": {"duration": "12.3456", "tags": {"make": " ", "com.apple.quicktime.make": "Apple", "creation_time": "2024-03-15T10:00:00.000000Z", "location": "+1+2/"}}, "streams": [{"codec_type": "video", "width": 10}]}'
    coded = '{"format": {"tags": {"make": "Lavf58"}}}'
    p = [r[0] for r in spark.createDataFrame([(probe,), (coded,), ("junk",), (None,)], "j string").coalesce(1).select(media.probe_metadata(F.col("j"))).collect()]
    assert (p[0].duration_seconds, p[0].make, p[0].has_location, str(p[0].date), p[0].width) == (12.346, "Apple", True, "2024-03-15 10:00:00", 10)
    assert p[1].make is None and p[1].duration_unknown and p[2].make is None
    t = spark.createDataFrame([('{"Make": "X", "CreateDate": "2024:03:15 10:00:00+02:00", "Orientation": 6}',)], "j string").select(media.tool_metadata(F.col("j")).alias("t")).first().t
    assert (t.make, str(t.date), t.orientation) == ("X", "2024-03-15 10:00:00", 6)


def test_audio_tags_and_enrichment(spark):
    d = spark.createDataFrame([("id3", {"TIT2": " T ", "TDRC": "2001-02"}, "f"), ("mp4", {}, "f"), (None, None, "f")], "c string, t map<string,string>, s string").coalesce(1)
    got = [r[0] for r in d.select(media.audio_tags(F.col("c"), F.col("t"), F.col("s"))).collect()]
    assert [(g.title, g.year, g.has_tags) for g in got] == [("T", 2001, True), ("f", None, False), ("f", None, False)]
    a = spark.createDataFrame([("t", None, None, "own", None), ("u", None, None, None, None)], "title string, artist string, album string, genre string, year int")
    r = spark.createDataFrame([("t", "A", "B", "ref", 1999, 90), ("t", "Z", "Z", "Z", 1, 10), ("u", "C", "C", "C", 1, 79)], "title string, artist string, album string, genre string, year int, score int")
    assert sorted(tuple(x) for x in media.enriched(a, r, ["title"]).collect()) == [("t", "A", "B", "own", 1999), ("u", None, None, None, None)]


RECORD = "id string, source_path string, sha256_hash string, file_size bigint, created_at timestamp, pipeline_stage int"


def test_stream_equals_batches_and_survives_repeats(spark, tmp_path):
    at = "2024-01-01 00:00:0"
    first = [("a", "/a", "X", 1, at + "1", 1), ("b", "/b", "sha256:x", 1, at + "2", 1), ("c", "/c", None, 1, at + "3", 1), ("a", "/a", None, 1, at + "1", 0)]
    second = [("d", "/d", "x", 1, at + "0", 1), ("e", "/e", "y", 1, at + "5", 1)]
    batches = [spark.createDataFrame(b, RECORD.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp")) for b in (first, second)]
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(src)
        q = ingest.start_ingest(spark, src, b.schema, root)
        q.awaitTermination()
    want = {"a": False, "b": True, "c": False, "d": True, "e": False}
    assert {r.file_id: r.is_duplicate for r in ingest.decisions(spark, root).collect()} == want
    ingest.ingest_batch(batches[1], 1, root)  # run again
    assert {r.file_id: r.is_duplicate for r in ingest.decisions(spark, root).collect()} == want and ingest.accepted(spark, root).count() == 2
