"""Consolidating pairwise matches into groups.

Vertices of degree one are stripped again and again and chains of vertices of degree two are compressed by list
ranking (pointer doubling along the chain), which together shrink any tree-like part by a constant factor each
round. What remains has a least degree of three; this core is solved by hooking each vertex to its smallest neighbour
and contracting. Labels are then restored to the removed vertices.

Nothing is keyed by a vertex except aggregates with a map-side part, so that a hub costs no task more than another:
edges are removed by their pair, pointers are followed by their dart, and lookups of labels go through skew_lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.runtime import cut, discard, seen_of, skew_lookup


def _ends(edges: DataFrame) -> DataFrame:
    """v, deg, lo, hi: each vertex with its degree, smallest and greatest neighbour."""
    darts = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))).alias("d")).select("d.*")
    return darts.groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("n").alias("lo"), F.max("n").alias("hi"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rake(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strips the vertices of degree one: (edges left, removed v with parent p). Of an edge between two of them
    the greater is removed."""
    leaves = _ends(edges).where("deg = 1").select("v", "lo")
    by_edge = leaves.select(*_pair("v", "lo"), "v").groupBy("a", "b").agg(F.max("v").alias("v"))
    gone = cut(by_edge.select("a", "b", "v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("p")), "leaves")
    return edges.join(gone.select("a", "b"), ["a", "b"], "left_anti"), gone


def _ahead(ptr: DataFrame) -> DataFrame:
    """One step of pointer doubling: each dart that hasn't ended moves on to what its successor points to. A dart whose
    successor isn't there has reached an end of its chain. news: whether a dart ended or saw a smaller vertex."""
    then = ptr.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
    ends = F.col("nu2").isNull() | F.col("done2")
    moved = ptr.where("not done").join(then, ["nu", "nv"], "left").select(
        "u", "v", F.coalesce("nu2", "nu").alias("nu"), F.coalesce("nv2", "nv").alias("nv"), F.least("least", "least2").alias("least"), ends.alias("done"),
        (F.col("news") | ends | (F.least("least", "least2") < F.col("least"))).alias("news"))
    return ptr.where("done").unionByName(moved)


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Compresses the chains of vertices of degree two: (edges left and those that replace chains, removed v with
    parent p). A cycle of such vertices is removed but for its smallest. None if there is no such vertex."""
    # Dart (u, v) enters v from u and points to the dart by which it leaves v: (v, w).
    darts = _ends(edges).where("deg = 2").select(F.explode(F.array(
        F.struct(F.col("lo").alias("u"), "v", F.col("v").alias("nu"), F.col("hi").alias("nv")),
        F.struct(F.col("hi").alias("u"), "v", F.col("v").alias("nu"), F.col("lo").alias("nv")))).alias("d")).select("d.*")
    first = cut(darts.select("u", "v", "nu", "nv", F.least("u", "v", "nv").alias("least"), F.lit(False).alias("done"), F.lit(False).alias("news")), "darts", rows=_rows())
    n = seen_of(first, "rows")
    if not n:
        return edges, None
    ptr, step = first, 0
    while True:
        # Two steps a job.
        new = cut(_ahead(_ahead(ptr.withColumn("news", F.lit(False)))), "darts", news=F.max("news"))
        if ptr is not first:
            discard(ptr)
        ptr, step = new, step + 2
        # Darts of a cycle never end. In a chain some dart ends at each step, so that when none did, and no dart saw a
        # smaller vertex, only cycles are left, and each of their darts has seen the least of its cycle.
        if not seen_of(ptr, "news") or 2**step > 2 * n:
            break
    both = ptr.groupBy("v").agg(F.min("nv").alias("e"), F.max("nv").alias("f"), F.min("least").alias("least"), F.bool_and("done").alias("ended"))
    gone = cut(both.select("v", F.when(F.col("ended"), F.col("e")).otherwise(F.col("least")).alias("p"), "e", "f", "ended"), "chains")
    discard(ptr)
    removed = first.select(*_pair("u", "v")).distinct()
    left = edges.join(removed, ["a", "b"], "left_anti")
    bridges = gone.where("ended AND e <> f").select(F.col("e").alias("a"), F.col("f").alias("b")).distinct()
    return left.unionByName(bridges).distinct(), gone.where("v <> p").select("v", "p")


def _rows():
    return F.count(F.lit(1))


def _flatten(parents: DataFrame) -> DataFrame:
    """v, p: each vertex with the root of its tree, by pointer doubling. A root is a p without a row of its own."""
    parents = cut(parents, "parents", rows=_rows())
    rows = seen_of(parents, "rows")

    def jump(x: DataFrame) -> DataFrame:
        up = x.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        return skew_lookup(x.select("v", "p"), up, "p", rows=rows).select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))

    moved = rows > 0
    while moved:
        # Two jumps a job; when the second moves nothing all point to roots.
        new = cut(jump(jump(parents)), "parents", moved=F.max("moved"))
        moved = seen_of(new, "moved")
        discard(parents)
        parents = new
    return parents.select("v", "p")


def _contract(edges: DataFrame) -> list[DataFrame]:
    """Solves the core: each round hooks every vertex to its smallest neighbour if that is smaller, and edges are
    carried over to the roots. Returns the hooks of each round (v, p)."""
    hooks = []
    left = edges.limit(1).count()
    while left:
        hook = _flatten(_ends(edges).where("lo < v").select("v", F.col("lo").alias("p")))
        hooks.append(hook)
        a = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        b = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = skew_lookup(skew_lookup(edges, a, "a"), b, "b").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        new = cut(moved.where("x <> y").select(*_pair("x", "y")).distinct(), "core", rows=_rows())
        discard(edges)
        edges, left = new, seen_of(new, "rows")
    return hooks


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", shrink: float = 0.98) -> DataFrame:
    """(id, group_id): each id of a pair with the smallest id of its group, ids being strings.

    Pairs may be repeated, in either order; pairs with a null side or of an id with itself link nothing, and an id
    with no other pair is left out. An empty input gives no rows. Rounds of stripping and compressing go on while
    each leaves at most `shrink` of the edges.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(f"{a} is not null and {b} is not null and x <> y").distinct()
    links = cut(links, "links")
    names = links.select(F.explode(F.array("x", "y")).alias("id")).distinct().orderBy("id")
    # Numbers in the order of the ids: the smallest number of a group is its smallest id.
    ids = cut(names.select("id", F.monotonically_increasing_id().alias("v")), "ids")
    edges = skew_lookup(skew_lookup(links, ids.select(F.col("id").alias("x"), F.col("v").alias("a")), "x"), ids.select(F.col("id").alias("y"), F.col("v").alias("b")), "y").select("a", "b")
    edges = cut(edges, "edges", rows=_rows())
    left = seen_of(edges, "rows")
    discard(links)
    removed: list[DataFrame] = []
    while left:
        before = left
        raked, gone = _rake(edges)
        removed.append(gone.select("v", "p"))
        edges = cut(raked, "edges", rows=_rows())
        left = seen_of(edges, "rows")
        if not left:
            break
        packed, chains = _compress(edges)
        if chains is not None:
            removed.append(chains)
            edges = cut(packed, "edges", rows=_rows())
            left = seen_of(edges, "rows")
        if left > shrink * before:
            break
    removed += _contract(edges)
    parents = spark.createDataFrame([], "v bigint, p bigint")
    for r in removed:
        parents = parents.unionByName(r)
    parents = _flatten(parents)
    least = parents.groupBy("p").agg(F.least(F.min("v"), F.first("p")).alias("m"))
    least = least.join(ids.select(F.col("v").alias("m"), F.col("id").alias("group_id")), "m").select("p", "group_id")
    roots = parents.select(F.col("p").alias("v"), "p").distinct()
    members = skew_lookup(parents.unionByName(roots), cut(least, "groups"), "p")
    return members.join(ids, "v").select("id", "group_id")


def match_links(matches: DataFrame, least: float = 0.95) -> DataFrame:
    """(a, b) of the rows of perceptual_match that link two files: different ids and a similarity of at least `least`.

    A similarity above 1 is a percentage. Null and NaN similarities, and rows that lack an id, link nothing; one row
    that links is enough if others contradict it.
    """
    from assetlake.functions.ids import norm_id

    s = F.col("similarity")
    share = F.when(s > 1, s / 100).otherwise(s)
    return matches.where(s.isNotNull() & ~F.isnan(s) & (share >= least)).select(norm_id("file_a_id").alias("a"), norm_id("file_b_id").alias("b")).where("a <> b")
