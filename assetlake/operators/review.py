"""Changes that a reviewer makes to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_ids(records: DataFrame, changes: DataFrame, member: str = "file_id") -> DataFrame:
    """Ids of changes that no record has; reclassified() leaves them out, a caller may refuse them."""
    return changes.select(member).distinct().join(records.select(member), member, "left_anti")


def reclassified(records: DataFrame, changes: DataFrame, destination: Column, member: str = "file_id") -> DataFrame:
    """records with the category of `changes` (member, category; of several rows the greatest category) and, for those
    changed, the destination_path that `destination` makes of the changed row. Other rows stay as they are."""
    new = changes.where("category is not null").groupBy(member).agg(F.max("category").alias("_new"))
    j = records.join(new, member, "left").withColumn("category", F.coalesce("_new", "category"))
    path = F.when(F.col("_new").isNotNull(), destination).otherwise(F.col("destination_path"))
    return j.withColumn("destination_path", path).select(*records.columns)


def stage_errors(files: DataFrame, listing: DataFrame, path: str = "source_path") -> DataFrame:
    """files with stage_error: `file not found: path` for those that the listing (path) doesn't hold, `no destination path`
    for those without one, null for the others."""
    there = listing.select(F.col(path)).distinct().withColumn("_there", F.lit(True))
    j = files.join(there, path, "left")
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("file not found: "), F.coalesce(F.col(path), F.lit("")))).when(F.coalesce("destination_path", F.lit("")) == "", "no destination path")
    return j.withColumn("stage_error", error).select(*files.columns, "stage_error")
