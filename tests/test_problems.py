"""Snapshot diffs and instants against brute force."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from assetlake.functions import zones
from assetlake.operators import instants, snapshot_diff

SESSION = "id string, state string, created_at timestamp, updated_at timestamp, source_dirs array<string>, destination_dir string"
MANIFEST = "id bigint, session_id string, source_dir string, file_path string, file_size bigint, mtime double"
T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(days=n)


def brute_changes(sessions, manifest):
    current = {}
    for s in sorted(sessions, key=lambda s: s[3]):
        current[s[0].strip().lower()] = s
    files = {}
    for m in sorted(manifest, key=lambda m: m[0]):
        if m[3] is not None and m[1] is not None:
            files[m[1].strip().lower(), m[3]] = m
    chains = {}
    for key, s in current.items():
        if s[1].strip().lower() == "completed":
            for root in set(s[4] or ()):
                chains.setdefault((s[5], root), []).append((s[2], s[0], {p: m[4:] for (k, p), m in files.items() if k == key and m[2] == root}))
    out = set()
    for chain in chains.values():
        chain.sort(key=lambda c: c[0])
        for (_, _, a), (_, sid, b) in zip(chain, chain[1:]):
            out |= {(sid, p, "added") for p in b.keys() - a.keys()} | {(sid, p, "removed") for p in a.keys() - b.keys()} | {(sid, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_changes_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    sessions, manifest = [], []
    for k in range(9):
        sessions.append((f"S{k}", rnd.choice(["completed", "COMPLETED ", "stopped"]), at(k), at(k), rnd.choice([["/a"], ["/a", "/b", "/a"], ["/b"], [], None]), rnd.choice(["/lib", None])))
    sessions.append(("s1 ", "completed", at(1), at(20), ["/a", "/b"], "/lib"))
    for k in range(600):
        manifest.append((k, rnd.choice([f"s{rnd.randrange(9)}", f" S{rnd.randrange(9)}", None]), rnd.choice(["/a", "/b", None]), rnd.choice([f"/f{rnd.randrange(25)}", None]), rnd.choice([None, 1, 2]), rnd.choice([None, 1.0, 2.5])))
    got = snapshot_diff.manifest_changes(spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(sessions, SESSION))
    assert {tuple(r) for r in got.collect()} == brute_changes(sessions, manifest) and got.columns == ["session_id", "file_path", "change"]


@pytest.mark.parametrize("leaf_rows", [1, 4, 1000])
def test_changes_at_any_depth(spark, leaf_rows):
    rows = [("r", 1, 3, f"k{k}", k) for k in range(300)] + [("r", 3, 3, f"k{k}", k + (k == 7)) for k in range(5, 301)]
    snaps = spark.createDataFrame([("r", k, 3) for k in (1, 2, 3)], "root string, seq int, last int")
    d = spark.createDataFrame(rows, "root string, seq int, last int, key string, v int")
    got = snapshot_diff.snapshot_changes(d, snaps, "key", ["v"], leaf_rows)
    assert got.where("seq = 2 and change = 'removed'").count() == 300 and got.where("seq = 3 and change = 'added'").count() == 296 and got.count() == 596
    same = d.where("seq = 1").unionByName(d.where("seq = 1").withColumn("seq", F.lit(2)))
    assert snapshot_diff.snapshot_changes(same, snaps.where("seq < 3").withColumn("last", F.lit(2)), "key", ["v"], leaf_rows).count() == 0


def test_no_snapshots(spark):
    assert snapshot_diff.manifest_changes(spark.createDataFrame([], MANIFEST), spark.createDataFrame([], SESSION)).count() == 0


def brute_instant(wall, zone):
    """fold=0 is the earlier of two, and the offset before a gap."""
    local = dt.datetime.fromisoformat(wall).replace(tzinfo=ZoneInfo(zone), fold=0)
    return int((local.astimezone(dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def instants_of(spark, rows):
    d = spark.createDataFrame(rows, "text string, zone string")
    return [r.utc_us for r in instants.to_instants(d.withColumn("year", F.lit(1)).coalesce(1), "text", "zone").collect()]


def test_named_zones_against_brute_force(spark):
    rnd = random.Random(3)
    names = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu", "Africa/Casablanca", "Pacific/Apia", "Europe/Dublin", "America/Sao_Paulo", "Asia/Tehran"]
    rows = []
    for name in names:
        changes = [c for c, _ in zones._changes(name)[1:] if 0 < c < 4_000_000_000]
        for c in rnd.sample(changes, min(12, len(changes))):
            for shift in (-7200, -1800, -1, 0, 1, 1800, 3599, 3600, 5400):
                for off in {o for _, o in zones._changes(name)[-3:]}:
                    rows.append(((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=c + off + shift)).isoformat(" "), rnd.choice([name, name.upper(), f" {name} "])))
    got = instants_of(spark, rows)
    want = [brute_instant(t, next(n for n in names if n.lower() == z.strip().lower())) for t, z in rows]
    assert got == want


def test_texts_and_offsets(spark):
    utc = lambda *a: int((dt.datetime(*a) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    cases = [
        (("2024-03-15T12:00:00Z", "Europe/Berlin"), utc(2024, 3, 15, 12)), (("2024-03-15 12:00:00 +05:45", None), utc(2024, 3, 15, 6, 15)), (("2024:03:15 12:00:00.5-03", "x"), utc(2024, 3, 15, 15, 0, 0, 500000)),
        (("15.03.2024 12:00", "+0530"), utc(2024, 3, 15, 6, 30)), (("03/15/2024 12:05:00 AM", "UTC"), utc(2024, 3, 15, 0, 5)), (("03/15/2024 12:05:00 PM", "GMT-4"), utc(2024, 3, 15, 16, 5)),
        (("2024/03/15 01:02:03.123456789", "UTC+01:00"), utc(2024, 3, 15, 0, 2, 3, 123456)), (("Fri, 15 Mar 2024 12:00:00 GMT", None), utc(2024, 3, 15, 12)), (("20240315T120000", "Z"), utc(2024, 3, 15, 12)),
        (("1710504000", None), utc(2024, 3, 15, 12)), (("1710504000123", "Europe/Berlin"), utc(2024, 3, 15, 12, 0, 0, 123000)), ((" 2024-03-15T12:00\x00", "+00"), utc(2024, 3, 15, 12)),
        (("2024-10-27T02:30:00", "Europe/Berlin"), utc(2024, 10, 27, 0, 30)), (("2024-03-31T02:30:00", "Europe/Berlin"), utc(2024, 3, 31, 1, 30)),
        (("2024-03-15T12:00:00", None), None), (("2024-03-15T12:00:00", "local"), None), (("2024-03-15", "Z"), None), (("2024-02-30T12:00:00", "Z"), None), (("2024-03-15T24:00:00", "Z"), None), (("2024-03-15T12:60:00", "Z"), None),
        (("13/15/2024 12:00:00 PM", "Z"), None), (("03/15/2024 13:00:00 PM", "Z"), None), (("", "Z"), None), ((None, "Z"), None), (("    :  :     :  :  ", "Z"), None), (("x" * 5000, "Z"), None), (("2024-03-15T12:00:00", "Mars/Base"), None),
    ]
    assert instants_of(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_current_rows_count(spark):
    r = spark.createDataFrame(
        [("A", 1, "2020-01-01T00:00:00Z", "metadata", None), (" a", 5, "2021-01-01T00:00:00Z", "Metadata", None), ("b", 1, "2020-01-01T00:00:00Z", "NONE", None), ("c", 1, None, "metadata", "Z"), (None, 1, "2020-01-01T00:00:00Z", "metadata", None)],
        "id string, pipeline_stage int, date_value string, date_source string, timezone_offset string",
    ).withColumn("created_at", F.lit(None).cast("timestamp"))
    e = spark.createDataFrame([("A", "2020-01-01T00:00:00Z", None)] * 2 + [(None, "2020-01-01T00:00:00Z", None)], "file_id string, date_original string, timezone_offset string")
    assert sorted((x.file_id, x.origin, x.utc_us) for x in instants.recorded_instants(r, e).collect()) == [("a", "exif", 1577836800000000), ("a", "record", 1609459200000000)]
    assert instants.recorded_instants(r.limit(0), e.limit(0)).count() == 0


def test_instants_of_years_outside_the_zone_table(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    from assetlake.operators import instants

    rows = [(f"{y}-{m:02}-15 12:30:00", z) for y in (1850, 1884, 1899, 1900, 2100, 2101, 2128, 2129, 2200, 2400, 9998) for m in (1, 3, 7, 11) for z in ("America/New_York", "Europe/Paris", "Australia/Sydney", "Asia/Tokyo", "Africa/Casablanca")]
    got = instants.to_instants(spark.createDataFrame(rows, "t string, z string"), "t", "z").collect()
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    want = {r: (dt.datetime.fromisoformat(r[0]).replace(tzinfo=ZoneInfo(r[1])) - epoch) // dt.timedelta(microseconds=1) for r in rows}
    assert {(r.t, r.z): r.utc_us for r in got} == want


RECORDS = "id string, pipeline_stage int, date_value string, date_source string, timezone_offset string"


def test_zones_beside_the_text(spark):
    """The zone of a delivered column counts where the text has none, and names of helpers may be those of columns."""
    r = spark.createDataFrame([("a", 1, "2024-03-15 12:00:00", "metadata", "+02:00"), ("b", 1, "2024-03-15 12:00:00", "parsed", "America/New_York"), ("c", 1, "2024-03-15T12:00:00-03", "parsed", "Asia/Tokyo"), ("d", 1, "2024-03-15 12:00:00", "parsed", "local")], RECORDS)
    e = spark.createDataFrame([("a", "2024:03:15 12:00:00", "Asia/Kolkata"), ("b", "2024:03:15 12:00:00", None)], "file_id string, date_original string, timezone_offset string")
    noon = 1710504000000000
    want = {("a", "record"): noon - 2 * 3600 * 10**6, ("b", "record"): noon + 4 * 3600 * 10**6, ("c", "record"): noon + 3 * 3600 * 10**6, ("a", "exif"): noon - 19800 * 10**6}
    assert {(x.file_id, x.origin): x.utc_us for x in instants.recorded_instants(r, e).collect()} == want
    clash = spark.createDataFrame([("2024-03-15 12:00:00", "+01", 1, "x", None, 5)], "said string, z string, us int, row string, zone_key string, spans int")
    got = instants.to_instants(clash, "said", "z", "off").first()
    assert got.off == noon - 3600 * 10**6 and got.us == 1 and got.row == "x" and got.spans == 5


def test_instants_dont_depend_on_the_session_zone(spark):
    rows = [("2024-03-15T12:00:00Z", None), ("2024-03-10 02:30:00", "+00:00"), ("2024-03-10 02:30:00", "America/New_York"), ("1969-12-31 23:59:59.5", "Z"), ("2300-07-01 00:00:00", "Europe/Paris")]
    want = instants_of(spark, rows)
    assert want[:4] == [1710504000000000, 1710037800000000, 1710055800000000, -500000]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert instants_of(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
