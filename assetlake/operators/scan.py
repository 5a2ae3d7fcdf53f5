"""Scans of source folders against what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions.paths import reject_reason


def classified(listing: DataFrame, path: str = "source_path", size: str = "file_size") -> DataFrame:
    """listing with reject_reason, null for files that a scan keeps."""
    return listing.withColumn("reject_reason", reject_reason(F.col(path), F.col(size)))


def scan_totals(listing: DataFrame, size: str = "file_size") -> DataFrame:
    """reject_reason ('kept' for none), files, bytes of a classified listing."""
    return listing.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def changed_since(listing: DataFrame, manifest: DataFrame, path: str = "source_path", version: str = "id") -> DataFrame:
    """Files of the listing that are new or differ in size or mtime from the manifest's latest row of their path.

    listing: path, file_size, mtime and others; manifest: path, file_size, mtime and version. Files that are gone are
    not reported; see snapshot_diff for those. Missing values equal each other.
    """
    known = manifest.groupBy(path).agg(F.max_by(F.struct("file_size", "mtime"), version).alias("_m"))
    j = listing.join(known, path, "left")
    same = F.col("_m").isNotNull() & F.col("file_size").eqNullSafe(F.col("_m.file_size")) & F.col("mtime").eqNullSafe(F.col("_m.mtime"))
    why = F.when(F.col("_m").isNull(), "new").when(~F.col("file_size").eqNullSafe(F.col("_m.file_size")), "size").otherwise("mtime")
    return j.where(~same).withColumn("change", why).select(*listing.columns, "change")


def manifest_rows(listing: DataFrame, session_id: str) -> DataFrame:
    """The rows that a scan adds to the manifest."""
    return listing.select(F.lit(session_id).alias("session_id"), "source_dir", F.col("source_path").alias("file_path"), "file_size", "mtime")


def not_completed(files: DataFrame, completed: DataFrame, path: str = "source_path") -> DataFrame:
    """Files whose path isn't among the completed ones."""
    return files.join(completed.select(path).distinct(), path, "left_anti").select(*files.columns)
