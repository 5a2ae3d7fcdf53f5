"""Exact duplicates by content hash, within a catalogue and against a manifest of what was accepted before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.runtime import cut, running


def survivor_key(path: str = "source_path", mtime: str = "mtime") -> Column:
    """Order of survival: shorter path, earlier mtime (a missing one last), smaller path."""
    return F.struct(F.length(path).alias("n"), F.coalesce(F.col(mtime), F.lit(float("inf"))).alias("m"), F.col(path).alias("p"))


def survivors(files: DataFrame, by: list[str], key: Column | None = None) -> DataFrame:
    """files with is_duplicate: false for the best of each group of equal `by`, true for the rest. Rows with a null in
    `by` are never duplicates. Two rows that are equal in all of the key count as one survivor and a duplicate.

    The best of each group is an aggregate with a map-side part, so that no task sorts a hot group.
    """
    key = key if key is not None else survivor_key()
    # Cut first: the numbers that tell equal rows apart must be the same on both sides of the join.
    marked = cut(files.withColumn("_k", F.struct(*key_fields(key, files))).withColumn("_row", F.monotonically_increasing_id()), "survivors")
    whole = marked.where(" and ".join(f"{c} is not null" for c in by))
    best = whole.groupBy(*by).agg(F.min(F.struct("_k", "_row")).alias("_best"))
    joined = marked.join(best, by, "left")
    dup = F.coalesce(F.struct("_k", "_row") != F.col("_best"), F.lit(False))
    return joined.withColumn("is_duplicate", dup).select(*files.columns, "is_duplicate")


def key_fields(key: Column, files: DataFrame) -> list[Column]:
    kind = files.select(key.alias("k")).schema["k"].dataType
    return [key[f.name].alias(f.name) for f in kind.fields]


def arrival_duplicates(files: DataFrame, by: list[str], arrival: str, key: Column | None = None) -> DataFrame:
    """files with is_duplicate as a stream would decide it in order of arrival (which must tell the files of a group
    apart): a file is kept if it ranks below all that came before it in its group. A group is spread over tasks."""
    key = key if key is not None else survivor_key()
    some = F.lit(True)
    for c in by:
        some = some & F.col(c).isNotNull()
    keyed = files.withColumn("_k", F.struct(*key_fields(key, files)))
    whole = running(keyed.where(some), by, [arrival], {"_before": ("min", F.col("_k"))}, before=True)
    decided = whole.select(*files.columns, F.coalesce(F.col("_before") <= F.col("_k"), F.lit(False)).alias("is_duplicate"))
    return decided.unionByName(files.where(~some).withColumn("is_duplicate", F.lit(False)))


def duplicate_groups(files: DataFrame, by: list[str], size: str = "file_size", member: str = "file_id", key: Column | None = None) -> DataFrame:
    """by, winner_file_id, file_count, bytes_saved of each group of at least two: the sizes of all but the winner."""
    key = key if key is not None else survivor_key()
    some = files.where(" and ".join(f"{c} is not null" for c in by))
    g = some.groupBy(*by).agg(F.count(F.lit(1)).alias("file_count"), F.sum(size).alias("_all"), F.min(F.struct(key.alias("k"), F.col(member).alias("id"), F.col(size).alias("size"))).alias("_w"))
    return g.where("file_count >= 2").select(*by, F.col("_w.id").alias("winner_file_id"), "file_count", (F.col("_all") - F.col("_w.size")).alias("bytes_saved"))


def in_manifest(files: DataFrame, manifest: DataFrame, on: str = "sha256_hash") -> DataFrame:
    """files whose hash the manifest holds."""
    return files.join(manifest.select(on).where(f"{on} is not null").distinct(), on, "left_semi").select(*files.columns)


def not_in_manifest(files: DataFrame, manifest: DataFrame, on: str = "sha256_hash") -> DataFrame:
    """files whose hash the manifest doesn't hold; those without a hash among them."""
    return files.join(manifest.select(on).where(f"{on} is not null").distinct(), on, "left_anti").select(*files.columns)


def merge_manifest(manifest: DataFrame, new: DataFrame, on: str = "sha256_hash", version: str = "added_at") -> DataFrame:
    """One row per hash of both: the latest by `version`, the new one among equals."""
    cols = manifest.columns
    both = manifest.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    best = both.where(f"{on} is not null").groupBy(on).agg(F.max_by(F.struct(*cols), F.struct(version, "_new")).alias("r"))
    return best.select("r.*")


def remove_from_manifest(manifest: DataFrame, gone: DataFrame, on: str = "sha256_hash") -> DataFrame:
    return not_in_manifest(manifest, gone, on)
