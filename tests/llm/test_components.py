import random

import pytest
from pyspark.sql import functions as F

from assetlake.llm import components


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def groups(spark, pairs):
    d = spark.createDataFrame(pairs, "a string, b string").withColumn("v", F.lit(1)).withColumn("p", F.lit("x"))
    rows = components.connected_groups(d).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.group_id for r in rows}


rnd = random.Random(4)
GRAPHS = {
    "path": [(f"{k:03}", f"{k + 1:03}") for k in range(70)],
    "cycles": [(f"c{k}", f"c{(k + 1) % 9}") for k in range(9)] + [("x", "y"), ("y", "z"), ("z", "x")],
    "star with tail": [("hub", f"l{k}") for k in range(50)] + [("l0", "t1"), ("t1", "t2"), ("t2", "t3")],
    "theta": [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("a", "f"), ("f", "g"), ("g", "d"), ("q", "a")],
    "dense": [(f"{rnd.randrange(25):02}", f"{rnd.randrange(25):02}") for _ in range(120)],
    "sparse": [(f"{rnd.randrange(120):03}", f"{rnd.randrange(120):03}") for _ in range(100)],
    "dirty": [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a"), ("z", "z"), (None, "a"), ("q", None), (None, None), ("B", "b")],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_groups_like_union_find(spark, name):
    assert groups(spark, GRAPHS[name]) == brute(GRAPHS[name])


def test_links_of_matches(spark):
    rows = [
        ("A", "b", 0.95), ("c", "D ", 95.0), ("e", "f", 0.9499), ("g", "h", 94.9), ("i", "j", float("nan")), ("k", "l", None), ("m", "M", 1.0), (None, "n", 1.0), ("", "o", 1.0),
        ("e", "p", 0.1), ("e", "p", 1.0),
    ]
    got = components.match_links(spark.createDataFrame(rows, "file_a_id string, file_b_id string, similarity double"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("c", "d"), ("e", "p")]
