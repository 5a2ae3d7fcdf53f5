"""What changed between consecutive full snapshots.

The rows of each snapshot fall into hash ranges of their key. A digest of each range is built bottom-up into a
tree, the trees of consecutive snapshots are compared top-down, and rows are compared only within ranges whose
digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions.ids import norm_id
from assetlake.runtime import bounded_broadcast, cut

#: Children of a tree node; leaves are FANOUT ** depth.
FANOUT = 16
#: Rows that a leaf should hold on average; decides the depth only.
LEAF_ROWS = 64


def snapshot_chain(sessions: DataFrame) -> DataFrame:
    """One row per snapshot (root, session): root_id, session_key, session_id, source_dir, seq from 1, last.

    The current row of a session is the one with the greatest updated_at; it counts if its state is completed, in
    any case. A null source_dirs lists nothing; a root listed twice counts once. root_id is a number that holds within
    one evaluation: write the result before it is used twice.
    """
    current = sessions.groupBy(norm_id("id").alias("session_key")).agg(
        F.max_by(F.struct("id", "state", "created_at", "source_dirs", "destination_dir"), F.struct("updated_at", "created_at")).alias("s")
    )
    roots = current.where(F.lower(F.trim("s.state")) == "completed").select(
        "session_key", F.col("s.id").alias("session_id"), "s.destination_dir", "s.created_at", F.explode(F.array_distinct("s.source_dirs")).alias("source_dir")
    )
    roots = roots.select("*", F.monotonically_increasing_id().alias("n"))
    order = Window.partitionBy("destination_dir", "source_dir").orderBy("created_at", "session_key")
    every = Window.partitionBy("destination_dir", "source_dir")
    return roots.select(
        F.min("n").over(every).alias("root_id"), "session_key", "session_id", "destination_dir", "source_dir",
        F.row_number().over(order).alias("seq"), F.count(F.lit(1)).over(every).alias("last"),
    )


def _digest(*cols: Column) -> list[Column]:
    """An order-free digest of a set of rows: their count and two independent 64-bit hashes, combined."""
    # A null leaves the hash as it is, so that each column's nullness is hashed too.
    cols = (*cols, *(c.isNull() for c in cols))
    return [
        F.count(F.lit(1)).alias("d0"),
        F.bit_xor(F.xxhash64(*cols)).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit("second"), *cols)).alias("d2"),
    ]


def differing_ranges(rows: DataFrame, snapshots: DataFrame, depth: int) -> DataFrame:
    """(root, seq, leaf) whose range differs from that of the snapshot before, found top-down.

    rows: root, seq, leaf and the digest columns d0, d1, d2 of each leaf. snapshots: root, seq (every snapshot,
    also one without rows). The node of level k is the leaf's number divided by FANOUT ** (depth - k).
    """
    levels = [rows]
    for _ in range(depth):
        below = levels[0]
        levels.insert(0, below.groupBy("root", "seq", F.shiftright("leaf", 4).alias("leaf")).agg(
            F.sum("d0").alias("d0"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")))
    # Level 0: all consecutive pairs of snapshots are open.
    open_nodes = snapshots.where("seq > 1").select("root", "seq", F.lit(0).cast("bigint").alias("leaf"))
    for k, level in enumerate(levels):
        digest = F.struct("d0", "d1", "d2").alias("digest")
        here = level.select("root", "seq", "leaf", digest)
        before = level.select("root", (F.col("seq") + 1).alias("seq"), "leaf", digest)
        # A node that only one of the two has differs; one full outer comparison by grouping, no join of rows.
        both = here.select("*", F.lit(1).alias("side")).unionByName(before.select("*", F.lit(0).alias("side")))
        differs = both.groupBy("root", "seq", "leaf").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1 OR a <> b")
        found = differs.select("root", "seq", "leaf", F.shiftright("leaf", 4).alias("up") if k else F.col("leaf").alias("up"))
        parents = open_nodes.select("root", "seq", F.col("leaf").alias("up"))
        open_nodes = found.join(parents, ["root", "seq", "up"], "left_semi").select("root", "seq", "leaf")
    return open_nodes


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str, values: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(root, seq, key, change) for each difference of two consecutive snapshots of a root.

    rows: root, seq, key (one row per key in a snapshot) and values. snapshots: root, seq, last (one row each, seq
    gapless from 1). change is added, removed or changed; values are compared exactly, null equalling null (NaN
    equals NaN). The first snapshot gives no rows. A null key is a key like any other. Empty inputs give no rows.
    """
    rows = rows.select("root", "seq", "last", F.col(key).alias("key"), F.struct(*values).alias("value"))
    rows = cut(rows, "snapshot-rows")
    total = rows.count()
    per_snapshot = max(1, total // max(1, snapshots.count()))
    depth = 1
    while FANOUT**depth * leaf_rows < per_snapshot and depth < 6:
        depth += 1
    leaf = F.pmod(F.xxhash64("key"), F.lit(FANOUT**depth)).alias("leaf")
    rows = rows.select("*", leaf)
    leaves = cut(rows.groupBy("root", "seq", "leaf").agg(*_digest(F.col("key"), *(F.col("value")[c] for c in values))), "snapshot-leaves")
    differ = cut(differing_ranges(leaves, snapshots, depth), "snapshot-differ")
    # Each open range needs its rows of both snapshots.
    need = differ.select("root", "seq", "leaf", F.lit(True).alias("here"), F.lit(False).alias("next")).unionByName(
        differ.select("root", (F.col("seq") - 1).alias("seq"), "leaf", F.lit(False).alias("here"), F.lit(True).alias("next"))
    ).groupBy("root", "seq", "leaf").agg(F.max("here").alias("here"), F.max("next").alias("next"))
    kept = rows.join(bounded_broadcast(need), ["root", "seq", "leaf"])
    w = Window.partitionBy("root", "key").orderBy("seq")
    seen = kept.select(
        "root", "key", "seq", "last", "value", "here", "next",
        F.lag("seq").over(w).alias("seq_before"), F.lag("value").over(w).alias("value_before"), F.lead("seq").over(w).alias("seq_after"),
    )
    at = F.col("seq")
    follows = F.coalesce(F.col("seq_before") == at - 1, F.lit(False))
    followed = F.coalesce(F.col("seq_after") == at + 1, F.lit(False))
    arrived = F.when(F.col("here") & ~follows, F.struct(at.alias("seq"), F.lit("added").alias("change"))).when(
        F.col("here") & ~F.col("value").eqNullSafe(F.col("value_before")), F.struct(at.alias("seq"), F.lit("changed").alias("change"))
    )
    left = F.when(F.col("next") & (at < F.col("last")) & ~followed, F.struct((at + 1).alias("seq"), F.lit("removed").alias("change")))
    return seen.select("root", "key", F.explode(F.array_compact(F.array(arrived, left))).alias("x")).select("root", "x.seq", F.col("key").alias(key), "x.change")


def manifest_changes(manifest: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, file_path, change) of every file that differs between consecutive snapshots of a root.

    The current row of (session, path) has the greatest id. Rows of sessions that aren't completed, or of roots
    that the session doesn't list, belong to no snapshot. Rows without session or path are ignored.
    """
    chain = cut(snapshot_chain(sessions), "snapshots")
    taken = bounded_broadcast(chain.select("session_key").distinct())
    current = (
        manifest.select(norm_id("session_id").alias("session_key"), "source_dir", "file_path", "id", "file_size", "mtime")
        .where("file_path is not null")
        .join(taken, "session_key", "left_semi")
        .groupBy("session_key", "file_path")
        .agg(F.max_by(F.struct("source_dir", "file_size", "mtime"), "id").alias("m"))
        .select("session_key", "file_path", "m.source_dir", "m.file_size", "m.mtime")
    )
    snap = chain.select("session_key", "source_dir", F.col("root_id").alias("root"), "seq", "last")
    rows = current.join(bounded_broadcast(snap), ["session_key", "source_dir"]).select("root", "seq", "last", "file_path", "file_size", "mtime")
    found = snapshot_changes(rows, snap.select("root", "seq", "last"), "file_path", ["file_size", "mtime"])
    names = chain.select(F.col("root_id").alias("root"), "seq", "session_id")
    return found.join(bounded_broadcast(names), ["root", "seq"]).select("session_id", "file_path", "change")
