import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetlake.llm import packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3), st.integers(0, 20)), max_size=80))
def test_limits_hold_in_all_resources(items):
    limit = np.array([50, 5, 30])
    demand = np.array(items, np.int64).reshape(-1, 3)
    bins = packing.pack_shard(demand, limit)
    assert len(bins) == len(items)
    for b in set(bins.tolist()):
        assert (demand[bins == b].sum(axis=0) <= limit).all()


def test_little_space_is_left():
    rnd = np.random.default_rng(1)
    t = rnd.integers(20, 2500, 3000)
    bins = packing.pack_shard(np.stack([t, np.ones_like(t), t], axis=1), np.array([4096, 256, 4096]))
    assert len(set(bins.tolist())) <= 1.01 * t.sum() / 4096 + 1


def test_documents_round_trip(spark):
    texts = ["", None, "a" * 4095, "a" * 4096, "é" * 5000, "€" * 9001, "😀x" * 4000, "short", "short", "b" * 40_000]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").withColumn("piece", F.lit("clash")).withColumn("tokens", F.lit(None).cast("string"))
    rows = packing.pack_documents(d).collect()
    assert {r.doc_id for r in packing.split_ids(packing.pack_documents(d)).collect()} == {k for k, t in enumerate(texts) if t and len(t.encode()) + 1 > 4096}
    for k, t in enumerate(texts):
        raw, mine = (t or "").encode(), sorted((r.piece, r.start, r.tokens) for r in rows if r.doc_id == k)
        parts = [raw[s : s + n] for _, s, n in mine]
        assert b"".join(parts) == raw and sum(n for _, _, n in mine) == len(raw) + 1 and [p for p, _, _ in mine] == list(range(len(mine)))
        assert all(p.decode() is not None for p in parts) and all(0 < n <= 4096 for _, _, n in mine)
    fill = packing.container_fill(packing.pack_documents(d)).first()
    assert fill.tokens == sum(len((t or "").encode()) + 1 for t in texts)


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_shards_and_repeats(spark, shard):
    d = spark.createDataFrame([(1, 5, 1, 5)] * 7 + [(2, 10, 1, 0)], "k bigint, tokens bigint, segments bigint, loss_tokens bigint")
    got = packing.pack_items(d, (10, 2, 10), shard).groupBy("container_id").agg(F.sum("tokens").alias("t"), F.sum("segments").alias("s")).collect()
    assert sum(r.t for r in got) == 45 and all(r.t <= 10 and r.s <= 2 for r in got)
    assert packing.pack_items(d.limit(0), (10, 2, 10)).count() == 0


def test_items_beyond_a_limit_are_alone():
    bins = packing.pack_shard(np.array([[4, 1, 9], [4, 1, 1], [20, 1, 1], [6, 1, 1]]), np.array([10, 2, 5])).tolist()
    assert bins[1] == bins[3] and len(set(bins)) == 3


def test_loss_and_segments_bind(spark):
    rnd = np.random.default_rng(2)
    d = spark.createDataFrame([(k, "p" * int(rnd.integers(0, 40)) + "|" + "x" * int(rnd.integers(1, 150))) for k in range(200)], "doc_id bigint, text string")
    limits = {"capacity": 100, "segments": 2, "loss_tokens": 60}
    proof = packing.packing_proof(packing.pack_documents(d, **limits, prompt=F.locate("|", F.col("text"))), **limits).first()
    assert (proof.documents, proof.overfull, proof.gaps) == (200, 0, 0)
    assert proof.tokens == d.selectExpr("sum(octet_length(text) + 1)").first()[0] and proof.loss_tokens == d.selectExpr("sum(octet_length(text) + 1 - locate('|', text))").first()[0]
