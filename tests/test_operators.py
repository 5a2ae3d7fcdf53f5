"""Small cases of the catalogue operators, with nulls, ties, repeated and no rows."""

import random

import pytest
from pyspark.sql import functions as F

from assetlake.functions.paths import extension
from assetlake.operators import dedup, destinations, grouping, scan, similarity
from assetlake.plans import reports
from assetlake.runtime import ranked, running, skew_lookup

FILES = "file_id string, source_path string, source_dir string, sha string, mtime double, file_size bigint, arrival bigint"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_survivor_rule(spark):
    rows = [
        ("a", "/long/path", "/", "x", 1.0, 5, 1), ("b", "/p", "/", "x", 9.0, 5, 2), ("c", "/q", "/", "y", 9.0, 5, 3), ("d", "/r", "/", "y", 1.0, 5, 4),
        ("e", "/s", "/", "z", None, 5, 5), ("f", "/t", "/", "z", 3.0, 5, 6), ("g", "/u", "/", None, 1.0, 5, 7), ("h", "/u", "/", None, 1.0, 5, 8), ("i", "/v", "/", "w", 1.0, 5, 9), ("j", "/v", "/", "w", 1.0, 5, 10),
    ]
    got = {r.file_id: r.is_duplicate for r in dedup.survivors(files(spark, rows), ["sha"]).collect()}
    assert {k for k, v in got.items() if v} - {"i", "j"} == {"a", "c", "e"} and got["i"] != got["j"]
    g = {r.sha: (r.winner_file_id, r.file_count, r.bytes_saved) for r in dedup.duplicate_groups(files(spark, rows), ["sha"]).collect()}
    assert g["x"] == ("b", 2, 5) and set(g) == {"x", "y", "z", "w"}


def test_arrival_order_keeps_better_latecomers(spark):
    rows = [("a", "/pp", "/", "x", 1.0, 1, 1), ("b", "/ppp", "/", "x", 1.0, 1, 2), ("c", "/p", "/", "x", 1.0, 1, 3), ("d", "/p", "/", "x", 1.0, 1, 4), ("e", "/z", "/", None, 1.0, 1, 5)]
    got = {r.file_id: r.is_duplicate for r in dedup.arrival_duplicates(files(spark, rows), ["sha"], "arrival").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_manifest(spark):
    m = spark.createDataFrame([("x", "old", 1), ("y", "old", 5)], "sha256_hash string, rel_path string, added_at int")
    n = spark.createDataFrame([("x", "new", 1), ("y", "late", 4), ("z", "new", 1), (None, "none", 1)], m.schema)
    assert sorted(map(tuple, dedup.merge_manifest(m, n).collect())) == [("x", "new", 1), ("y", "old", 5), ("z", "new", 1)]
    assert [r.sha256_hash for r in dedup.remove_from_manifest(m, n.where("sha256_hash = 'x'")).collect()] == ["y"]
    assert dedup.in_manifest(n, m.limit(0)).count() == 0 and dedup.not_in_manifest(n, m).count() == 2


def test_changed_since(spark):
    listing = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, None), ("d", None, 2.0)], "source_path string, file_size bigint, mtime double")
    known = spark.createDataFrame([("b", 1, 1.0, 1), ("b", 2, 1.0, 2), ("c", 1, None, 1), ("d", 1, 2.0, 1)], "source_path string, file_size bigint, mtime double, id bigint")
    assert sorted((r.source_path, r.change) for r in scan.changed_since(listing, known).collect()) == [("a", "new"), ("d", "size")]
    assert scan.changed_since(listing, known.limit(0)).count() == 4


def test_pairs_are_exactly_one_of_each(spark):
    rows = [(str(k), p, d, None, None, 0, k) for k, (p, d) in enumerate([
        ("/r/a/X.CR2", "/r"), ("/r/b/x.jpg", "/r"), ("/r/y.nef", "/r"), ("/r/y.dng", "/r"), ("/r/y.jpg", "/r"), ("/r/z.arw", "/r"), ("/q/z.jpg", "/q"), ("/r/w.arw", "/r/"), ("/r/w.jpeg", "/r")])]
    f = files(spark, rows)
    p = grouping.raw_jpeg_pairs(f)
    assert sorted(map(tuple, p.collect())) == [("/r/a/X.CR2", "/r/b/x.jpg", "x"), ("/r/w.arw", "/r/w.jpeg", "w")]
    assert {r.file_id: r.pair_id for r in grouping.link_pairs(f, p).collect() if r.pair_id} == {"0": "1", "1": "0", "7": "8", "8": "7"}


def test_sidecars(spark):
    rows = [(str(k), p, "/", None, None, 0, k) for k, p in enumerate(["/d/v.mp4", "/d/V.srt", "/d/v.mp4.srt", "/d/v.mp4.en.srt", "/e/v.srt", "/d/v2.srt", "/d/v.en.srt"])]
    assert sorted(r.sidecar_path for r in grouping.sidecars(files(spark, rows)).collect()) == ["/d/V.srt", "/d/v.mp4.en.srt", "/d/v.mp4.srt"]


def test_bursts_are_exclusive_and_numbered(spark):
    at = "2024-01-01 00:00:0"
    rows = [("a", "x_BURST1.jpg", "C", at + "1", False), ("b", "x_BURST2.jpg", "C", at + "1", False), ("c", "q.jpg", "C", at + "1.7", False), ("d", "r.jpg", "C", at + "1", False), ("e", "s.jpg", None, at + "2", False),
        ("f", "t.jpg", None, at + "2", False), ("g", "u.jpg", None, at + "2", False), ("h", "v.jpg", "D", None, True), ("i", "W.jpg", "D", None, True)]
    f = spark.createDataFrame(rows, "file_id string, source_path string, cam string, t string, flag boolean").withColumn("date", F.col("t").cast("timestamp_ntz"))
    got = {r.file_id: (r.layer, r.burst_index) for r in grouping.bursts(f, F.col("cam"), F.col("date"), F.col("flag"), ("*_BURST*",)).collect()}
    assert got == {"a": ("name", 0), "b": ("name", 1), "e": ("time", 0), "f": ("time", 1), "g": ("time", 2), "h": ("exif", 0), "i": ("exif", 1)}


def _brute_names(paths, taken):
    used, out = set(taken), []
    for p in paths:
        base, ext = p[: len(p) - len(_ext(p))], _ext(p)
        final, n = p, 0
        while final in used:
            n += 1
            final = f"{base}-{n}{ext}"
        used.add(final)
        out.append(final)
    return out


def _ext(p):
    import os

    return os.path.splitext(p)[1]


@pytest.mark.parametrize("seed", range(3))
def test_collisions_like_one_by_one(spark, seed):
    rnd = random.Random(seed)
    names = ["/l/a.jpg", "/l/a-1.jpg", "/l/a-2.jpg", "/l/a-1-1.jpg", "/l/b.jpg", "/l/c", "/l/.h", "/m/a.jpg", "/l/d-7.x"]
    paths = [rnd.choice(names) for _ in range(40)]
    taken = rnd.sample(names, 3)
    f = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k bigint, path string")
    got = destinations.without_collisions(f, "path", "k", spark.createDataFrame([(t,) for t in taken], "path string"))
    want = _brute_names(paths, taken)
    assert [r.final_path for r in got.orderBy("k").collect()] == want and len(set(want)) == len(want)
    plain = destinations.without_collisions(f.where("path in ('/l/b.jpg', '/l/c')"), "path", "k")
    assert sorted(r.final_path for r in plain.collect()) == sorted(_brute_names([p for p in paths if p in ("/l/b.jpg", "/l/c")], ()))


def test_collisions_of_nothing_and_of_large_families(spark, monkeypatch):
    f = spark.createDataFrame([(1, None), (2, "/a.x"), (3, "/a.x"), (4, "/a-5.x")], "k bigint, path string")
    assert destinations.without_collisions(f.limit(0), "path", "k").count() == 0
    monkeypatch.setattr(destinations, "FAMILY_ROWS", 2)
    got = [r.final_path for r in destinations.without_collisions(f, "path", "k").orderBy("k").collect()]
    assert got == [None, "/a.x", "/a-1.x", "/a-5.x"]


@pytest.mark.parametrize("seed", range(3))
def test_collisions_of_large_families_like_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(destinations, "FAMILY_ROWS", 1)
    rnd = random.Random(seed)
    names = ["/l/a.jpg", *(f"/l/a-{k}.jpg" for k in range(1, 12)), "/l/a-1-1.jpg", "/l/a-1-2.jpg", "/l/a-2-1-1.jpg", "/l/a-01.jpg", "/l/c", "/l/c-1", "/l/.h", "/l/.h-1", "/l/d-7.x", "/m/a.jpg"]
    weights = [9, *[rnd.choice([0, 1, 1, 3]) for _ in names[1:]]]
    paths = rnd.choices(names, weights, k=70) + ["/q/p-%d.jpg" % k for k in range(5)]
    taken = rnd.sample(names, 5)
    f = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k bigint, path string")
    got = destinations.without_collisions(f, "path", "k", spark.createDataFrame([(t,) for t in taken], "path string"))
    assert [r.final_path for r in got.orderBy("k").collect()] == _brute_names(paths, taken)
    some = destinations.without_collisions(f.where("path like '/q/%' or path like '/l/a%'"), "path", "k")
    assert [r.final_path for r in some.orderBy("k").collect()] == _brute_names([p for p in paths if p[:3] == "/q/" or p[:4] == "/l/a"], ())


def test_similar_codes_against_all_pairs(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(20)]
    codes = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for b in base for _ in range(6)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = {(r.code_a, r.code_b) for r in similarity.similar_codes(spark.createDataFrame([(str(c), c) for c in signed + signed[:5]] + [("n", None)], "id string, bits bigint")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_majority_is_strict(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 5), ("d", None)], "g string, v int")
    assert sorted((r.g, r.v, r.n, r.total) for r in reports.majority(d, ["g"], "v").collect()) == [("a", 1, 3, 4), ("c", 5, 1, 1)]


def test_undo_is_safe_from_nine_tenths(spark):
    rows = [("s", "completed", f"/{k}") for k in range(10)] + [("t", "completed", f"/{k}") for k in range(2, 12)] + [("u", "skipped", "/1")]
    r = spark.createDataFrame(rows, "session_key string, status string, destination_path string")
    there = spark.createDataFrame([(f"/{k}", 2) for k in range(9)], "path string, bytes bigint")
    assert {x.session_key: (x.files_present, x.safe_to_proceed) for x in reports.undo_check(r, there).collect()} == {"s": (9, True), "t": (7, False)}


def test_space_is_float_arithmetic(spark):
    assert spark.range(1).select(reports.space_needed(F.lit(5000))).first()[0] == 7151


def test_ranks_of_hot_keys(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    got = ranked(d, ["k"], ["o"], "n").where("k = 'hot'").orderBy("o").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_running_totals_of_hot_keys(spark):
    d = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("k")).alias("k"), (F.col("id") * 7919 % 901).alias("o"), (F.col("id") * 31 % 17).alias("v"))
    got = running(d, ["k"], ["o"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))})
    before = running(d, ["k"], ["o"], {"m": ("min", F.struct("v", "o"))}, before=True)
    rows = sorted(d.collect(), key=lambda r: r.o)
    for r in got.collect():
        past = [x.v for x in rows if x.k == r.k and x.o <= r.o]
        assert (r.s, r.m) == (sum(past), min(past))
    for r in before.collect():
        past = [(x.v, x.o) for x in rows if x.k == r.k and x.o < r.o]
        assert (None if r.m is None else tuple(r.m)) == min(past, default=None)
    assert running(d.limit(0), ["k"], ["o"], {"s": ("sum", F.col("v"))}).count() == 0


def test_lookup_of_hot_keys(spark):
    left = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    right = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    assert skew_lookup(left, right, "k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v")).first() == left.join(right, "k", "left").agg(F.count(F.lit(1)), F.count("v"), F.sum("v")).first()


def test_extension_of_numbered_names():
    assert extension(F.lit("a")) is not None and destinations._numbered("a.b.c", 2) == "a.b-2.c" and destinations._numbered(".h", 1) == ".h-1"


def test_sieve_keeps_all_that_are_asked_for(spark):
    from assetlake.runtime import bounded_broadcast, sieved

    d = spark.range(20_000).withColumn("text", F.lit("x"))
    asked = spark.createDataFrame([(k * 3,) for k in range(500)] + [(None,)], "id bigint")
    got = {r.id for r in sieved(d, "id", asked).collect()}
    assert {k * 3 for k in range(500)} <= got and len(got) < 600
    assert sieved(d, "id", asked.limit(0)).count() == 0
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(bounded_broadcast(wide)) and not hinted(bounded_broadcast(wide, rows=9)) and not hinted(bounded_broadcast(wide, size=5000))
