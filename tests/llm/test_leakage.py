import random

import pytest
from pyspark.sql import functions as F

from assetlake.llm import leakage

WORDS = [f"w{k}" for k in range(4000)]


def brute(items, docs):
    out = set()
    for i, a in items:
        w = a.split()
        for d, t in docs:
            text = f" {' '.join(t.split())} "
            hit = set()
            for k in range(len(w) - 4):
                if f" {' '.join(w[k : k + 5])} " in text:
                    hit |= set(range(k, k + 5))
            if hit and 3 * len(hit) >= len(w):
                out.add((i, d))
    return out


def found(spark, items, docs):
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1)).withColumn("n", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("w", F.lit("x")).withColumn("plain", F.lit(1))
    rows = [tuple(r) for r in leakage.leaked_items(i, d).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("length", [(5, 40), (30, 120), (2500, 3500)])
def test_leaks_like_brute_force(spark, length):
    rnd = random.Random(length[0])
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(*length)))) for k in range(12)]
    docs = []
    for k in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(len(w))
            parts += w[a : a + rnd.choice([3, 5, 6, len(w) // 3, len(w)])] + [rnd.choice(WORDS) for _ in range(20)]
        docs.append((k, " ".join(parts)))
    assert found(spark, items, docs) == brute(items, docs)


def test_items_of_repeated_lines(spark):
    """A line of five words that returns all over a long item is one different shingle, which no sketch may drop."""
    rnd = random.Random(3)
    items, docs = [], []
    for k in range(30):
        line = [f"r{k}x{j}" for j in range(5)]
        verse = lambda: [rnd.choice(WORDS) for _ in range(5)]
        items.append((k, " ".join(" ".join(line + verse()) for _ in range(100))))
        docs.append((k, " ".join(verse() + line + verse())))
    want = brute(items, docs)
    assert want == {(k, k) for k in range(30)} and found(spark, items, docs) == want


def test_writing_makes_no_difference(spark):
    item = "The quick brown fox jumps over the lazy dog today"
    docs = [
        (1, "<p>the <b>QUICK</b> brown\n\nfox, jumps -- over</p>"), (2, "ｔｈｅ ｑｕｉｃｋ brown ﬁx fox jumps"), (3, "xx ｔｈｅ quick&nbsp;brown* _fox_ jumps."), (4, ""), (5, None), (6, "quick brown fox jumps"),
        (7, "the quick brown fox jumpsover"), (8, "the quick brown fox jumps " * 3000), (None, item),
    ]
    assert found(spark, [(1, item), (1, item), (2, "too short a text"), (3, ""), (4, None), (None, item)], docs) == {(1, 1), (1, 3), (1, 8)}


def test_nothing_leaks_from_nothing(spark):
    assert found(spark, [], [(1, "a b c d e f")]) == set() and found(spark, [(1, "a b c d e f")], []) == set()


def test_sketches_are_thinned_by_size(spark):
    """Long items keep a share of their hashes; leaks that share few of those left are missed as rarely as asked for."""
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(2000))) for k in range(40)]
    docs = []
    for k, t in items:  # the least leak there is: runs of five words with others between them
        w = t.split()
        docs.append((k, " ".join(" ".join(w[a : a + 5]) + f" gap{k}" for a in range(0, 2000, 14))))
    want = brute(items, docs)
    assert want == {(k, k) for k in range(40)} == found(spark, items, docs)
    i, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    share = lambda miss: leakage.item_sketches(i, "item_id", "text", miss).count() / (40 * 1996)
    assert 0.1 < share(leakage.MISS) < 0.2 and share(0.2) < 0.02
    assert len({tuple(r) for r in leakage.leaked_items(i, d, miss=0.2).collect()} & want) >= 24
