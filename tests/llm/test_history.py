import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assetlake.llm import history

RECORD = "id string, session_id string, sha256_hash string, perceptual_hash string, pipeline_stage int, created_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def brute(records, sessions, hashes):
    began = {s[0].lower(): s[1] for s in sorted(sessions, key=lambda s: s[2])}
    current = {}
    for r in sorted(records, key=lambda r: r[4]):
        current[r[0].lower()] = r
    rows = [(k, began.get(r[1].lower()), r[2], None if r[3] is None else int(r[3], 16)) for k, r in current.items() if r[2] is not None and r[1].lower() in began]
    out = set()
    for f, t, sha, bits in rows:
        shas = {(sha, "exact")}
        shas |= {(s2, "near") for _, t2, s2, b2 in rows if t2 < t and s2 != sha and bits is not None and b2 is not None and bin(bits ^ b2).count("1") <= 3}
        for s, kind in shas:
            past = [h for h in hashes if h[0] == s and h[2] is not None and h[2] < t]
            if past:
                out.add((f, kind, max(past, key=lambda h: (h[2], h[1]))[1]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repeats_like_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(history, "CELL_VECTORS", [16, 1e-6][seed])  # the widest and the finest cells
    base = [rnd.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    sessions = [(f"S{k}", T0 + dt.timedelta(days=3 * k), T0) for k in range(6)] + [("s0", T0, T0 + dt.timedelta(days=1))]
    records = []
    for k in range(120):
        bits = rnd.choice(base)
        for _ in range(rnd.randrange(5)):
            bits ^= 1 << rnd.randrange(64)
        records.append((f"F{k % 100}", f"s{rnd.randrange(7)}", rnd.choice([None, *(f"h{x}" for x in range(25))]), rnd.choice([None, f"{bits:x}"]), k, None))
    hashes = [(f"h{rnd.randrange(25)}", f"p{k}", rnd.choice([None, *(T0 + dt.timedelta(days=x, hours=h) for x in range(-2, 20) for h in (0, 5))])) for k in range(60)]
    got = history.repeats_of_history(
        spark.createDataFrame(records, RECORD), spark.createDataFrame(sessions, "id string, created_at timestamp, updated_at timestamp").withColumn("state", F.lit("stopped")),
        spark.createDataFrame(hashes, "sha256_hash string, rel_path string, added_at timestamp"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == brute(records, sessions, hashes) and len(rows) == len(set(rows)) and any(r[1] == "near" for r in rows)


def near_pairs(vectors):
    return {(a, b) for a in vectors for b in vectors if bin(a ^ b).count("1") <= 3}


def probed(index, d):
    return {(r.query_bits, r.bits) for r in index.probe(d, F.lit(True)).collect()}


def test_batches_appended_one_by_one_give_the_same_pairs(spark, tmp_path, monkeypatch):
    """Opened anew for each batch; the cells are so small that the index outgrows its bands."""
    monkeypatch.setattr(history, "CELL_VECTORS", 0.0005)
    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(10)]
    vectors = sorted({b ^ sum(1 << rnd.randrange(60) for _ in range(rnd.randrange(5))) for b in base for _ in range(8)})
    d = spark.createDataFrame([(v, f"p{v}") for v in vectors], "bits bigint, name string")
    for k in range(3):
        history.CellIndex(spark, f"{tmp_path}/i").append(d.where(F.pmod("bits", F.lit(3)) == k))
    index = history.CellIndex(spark, f"{tmp_path}/i")
    assert index.r > history.bands_for(len(vectors) // 3 - 9, 3) and index.vectors == len(vectors) and probed(index, d) == near_pairs(vectors)
    with pytest.raises(ValueError):
        history.CellIndex(spark, f"{tmp_path}/i", radius=2)


def test_hot_cells_are_split(spark, tmp_path, monkeypatch):
    """Vectors that differ in few bits share the cells of three of four quantizers."""
    monkeypatch.setattr(history, "HOT_CELL", 30)
    vectors = sorted(random.Random(1).sample(range(1 << 12), 150)) + [-1, -2, 2**62]
    d = spark.createDataFrame([(v,) for v in vectors], "bits bigint")
    index = history.CellIndex(spark, f"{tmp_path}/i")
    index.append(d)
    want = {(a, b) for a in vectors for b in vectors if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert probed(index, d) == want


def test_sessions_checked_in_order_like_all_at_once(spark, tmp_path):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(4)]
    bits = lambda: f"{rnd.choice(base) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)):x}"
    records = [(f"f{k}", f"s{k % 3}", f"h{rnd.randrange(12)}", bits(), 1, None) for k in range(45)]
    sessions = [(f"s{k}", T0 + dt.timedelta(days=5 * k), T0) for k in range(3)]
    hashes = [(f"h{rnd.randrange(12)}", f"p{k}", T0 + dt.timedelta(days=rnd.randrange(-2, 12))) for k in range(30)]
    r, h = spark.createDataFrame(records, RECORD), spark.createDataFrame(hashes, "sha256_hash string, rel_path string, added_at timestamp")
    got = set()
    past = history.History(spark, str(tmp_path))
    past.accept(h)
    for s, began, _ in sessions:
        batch = r.where(F.col("session_id") == s).select(F.col("id").alias("file_id"), "sha256_hash", "perceptual_hash")
        got |= {tuple(x) for x in history.History(spark, str(tmp_path)).check(batch, began).collect()}
        past.append(batch)
    assert got == brute(records, sessions, hashes) and any(x[1] == "near" for x in got)


@pytest.mark.parametrize("r", [1, 2, 3, 6])
def test_quantizers_cover_the_vector(r):
    q = history.quantizers(r, 3)
    assert len(q) >= 4 and all(sum(w for _, w in bands) <= 63 for bands in q) and {b for bands in q for a, w in bands for b in range(a, a + w)} == set(range(64))
    for finer in history.split_quantizer(q[0], 3):
        assert sum(w for _, w in finer) > sum(w for _, w in q[0])
    assert history.split_quantizer([(0, 62)], 3) == []


def test_nothing_before(spark):
    r = spark.createDataFrame([("a", "s", "h", "ff", 1, None)], RECORD)
    s = spark.createDataFrame([("s", T0, T0)], "id string, created_at timestamp, updated_at timestamp").withColumn("state", F.lit(None).cast("string"))
    h = spark.createDataFrame([], "sha256_hash string, rel_path string, added_at timestamp")
    for x, y in ((r, s), (r.limit(0), s), (r, s.limit(0))):
        assert history.repeats_of_history(x, y, h).count() == 0
