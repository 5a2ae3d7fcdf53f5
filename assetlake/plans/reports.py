"""Reports over sessions and records: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import paths
from assetlake.functions.dates import name_date
from assetlake.functions.media import screenshot_size
from assetlake.rules import SOCIAL_PREFIXES, first_match
from assetlake.runtime import running


def session_stats(records: DataFrame, groups: DataFrame, by: str = "session_key") -> DataFrame:
    """Files by outcome of each session, and its duplicate groups with the bytes that they save. records: one row a
    file with status in lower case; groups: one row a group."""
    r = records.groupBy(by).agg(
        F.count_if(F.col("status") == "completed").alias("files_processed"), F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.count_if(F.col("status") == "error").alias("files_errored"))
    g = groups.groupBy(by).agg(F.count(F.lit(1)).alias("dupes_found"), F.sum("bytes_saved").alias("space_saved"))
    return r.join(g, by, "left").select(by, "files_processed", "files_skipped", "files_errored", F.coalesce("dupes_found", F.lit(0)).alias("dupes_found"), F.coalesce("space_saved", F.lit(0)).alias("space_saved"))


def preview(records: DataFrame) -> DataFrame:
    """One row: what a run would copy and skip, duplicates, bytes to copy, inferred dates."""
    done, skipped = F.col("status") == "completed", F.col("status") == "skipped"
    return records.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(done).alias("files_to_copy"), F.count_if(skipped | (F.col("status") == "error")).alias("files_to_skip"),
        F.count_if(skipped & (F.col("skip_reason") == "exact duplicate")).alias("duplicates_found"),
        F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)).alias("estimated_bytes"), F.count_if(F.col("date_source") == "inferred").alias("inferred_dates"))


def category_breakdown(records: DataFrame) -> DataFrame:
    return records.where("status = 'completed' and category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("files"))


def skip_breakdown(records: DataFrame) -> DataFrame:
    reason = F.when(F.col("status") == "error", "error").otherwise(F.coalesce("skip_reason", F.lit("unknown")))
    return records.where("status in ('skipped', 'error')").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def detail_rows(records: DataFrame) -> DataFrame:
    """The report of a session, a row a file, nulls as blanks."""
    action = first_match([(F.col("status") == "completed", "copy"), ((F.col("status") == "skipped") & (F.col("skip_reason") == "exact duplicate"), "duplicate"), (F.col("status") == "skipped", "skip")], "error")
    stub = paths.cloud_stub(F.col("source_path"), F.col("file_size"))
    warnings = F.concat_ws("; ", F.when(F.col("date_source") == "inferred", "inferred date"), F.when(stub.isNotNull(), F.concat(F.lit("cloud stub ("), stub, F.lit(")"))))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return records.select("source_path", blank("destination_path"), action.alias("action"), "category", "file_type", blank("date_value"), "date_source", "file_size", warnings.alias("warnings"))


def space_needed(bytes_: Column) -> Column:
    """Bytes that a copy may need at its peak; the order of the factors is part of the result."""
    return F.ceil(bytes_ * F.lit(1.3) * F.lit(1.1)).cast("bigint")


def space_check(needs: DataFrame, bytes_: str, available: str) -> DataFrame:
    """needs with required_bytes, passes, shortfall_bytes: whether the bytes to copy fit into those available."""
    out = needs.withColumn("required_bytes", space_needed(F.coalesce(F.col(bytes_), F.lit(0))))
    lack = F.col("required_bytes") - F.col(available)
    return out.withColumns({"passes": lack <= 0, "shortfall_bytes": F.greatest(lack, F.lit(0))})


def duplicate_savings(preview: DataFrame) -> DataFrame:
    """A preview with saved_bytes: duplicates times the mean size of the files to copy, 0 unless all three are above 0."""
    mean = F.col("estimated_bytes") / F.col("files_to_copy")
    some = (F.col("duplicates_found") > 0) & (F.col("files_to_copy") > 0) & (F.col("estimated_bytes") > 0)
    return preview.withColumn("saved_bytes", F.when(some, F.floor(F.col("duplicates_found") * mean)).otherwise(0).cast("bigint"))


def preview_warnings(facts: DataFrame) -> DataFrame:
    """(n, warning) in their order: what a preview warns of. facts: one row of total_files, files_to_copy,
    duplicates_found, inferred_dates, shortfall_bytes, cloud_stubs and unresolved_pairs."""
    c = F.col
    dup, inferred = c("duplicates_found") / c("total_files"), c("inferred_dates") / c("files_to_copy")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    # Fixed output texts and thresholds.
    told = F.array(
        F.when(c("shortfall_bytes") > 0, text("Insufficient disk space: ", F.format_string("%.1f", c("shortfall_bytes") / F.lit(1048576.0)), " MB shortfall")),
        F.when((c("total_files") > 0) & (dup > 0.5), text("High duplicate ratio: ", F.format_string("%.0f", dup * 100), "% of files are duplicates")),
        F.when((c("files_to_copy") > 0) & (inferred > 0.25), text(c("inferred_dates").cast("string"), " files have inferred dates (", F.format_string("%.0f", inferred * 100), "% of files to copy)")),
        F.when(c("cloud_stubs") > 0, text(c("cloud_stubs").cast("string"), " cloud stub(s) detected \u2014 files may not be downloaded locally")),
        F.when(c("unresolved_pairs") > 0, text(c("unresolved_pairs").cast("string"), " RAW+JPEG pair(s) have no pair policy set")),
    )
    return facts.select(F.posexplode(told).alias("n", "warning")).where("warning is not null")


def undo_check(records: DataFrame, listing: DataFrame, by: str = "session_key") -> DataFrame:
    """Destination files of each session that are still there, by a listing (path, bytes); safe if nine tenths are."""
    there = listing.groupBy("path").agg(F.max("bytes").alias("bytes"))
    j = records.where("status = 'completed' and destination_path <> ''").join(there, F.col("destination_path") == F.col("path"), "left")
    a = j.groupBy(by).agg(F.count(F.lit(1)).alias("total_files"), F.count("path").alias("files_present"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_to_free"))
    return a.select(by, "total_files", "files_present", (F.col("total_files") - F.col("files_present")).alias("files_missing"), "bytes_to_free", (F.col("files_present") * 10 >= F.col("total_files") * 9).alias("safe_to_proceed"))


def majority(rows: DataFrame, by: list[str], value: str, share: float = 0.5) -> DataFrame:
    """by, value, n, total: the value that more than `share` of a group's non-null rows have; groups without one have
    no row. Two aggregations, no group is collected."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.where(F.col("n") > F.col("total") * share)


def review_suggestions(records: DataFrame, sizes: tuple, tolerance: int) -> DataFrame:
    """A better category for each completed file of category Collection, with confidence and reason: camera, screen
    size, name, date in the name, majority of its folder, else none. records: file_id, source_path, source_dir,
    file_type, status, category, make, width, height."""
    ours = records.where("category = 'Collection' and status = 'completed'")
    votes = majority(records.where("status = 'completed' and category not in ('', 'Collection')"), ["source_dir"], "category").select("source_dir", F.col("category").alias("_most"))
    path, image = F.col("source_path"), F.col("file_type") == "image"
    # Fixed output texts and confidences.
    name, date = paths.basename(path), F.coalesce(name_date(paths.stem(path), 0.8), name_date(paths.parent_name(path), 0.6))
    made = lambda cat, sure, why: F.struct(cat.alias("suggested"), sure.alias("confidence"), why.alias("reason"))
    social = first_match([(name.startswith(p), p) for p in SOCIAL_PREFIXES])
    out = F.coalesce(
        F.when(image & F.col("make").isNotNull(), made(F.lit("Originals"), F.lit(0.9), F.concat(F.lit("Camera metadata found: "), F.col("make")))),
        F.when(image & screenshot_size(F.col("width"), F.col("height"), sizes, tolerance), made(F.lit("Screenshots"), F.lit(0.7), F.lit("Dimensions match common screenshot resolution"))),
        F.when(social.isNotNull(), made(F.lit("Social Media"), F.lit(0.7), F.concat(F.lit("Filename matches social media pattern: "), social, F.lit("*")))),
        F.when(date.isNotNull(), made(F.lit("Export"), date["confidence"], F.lit("Date found in filename"))),
        F.when(F.col("_most").isNotNull(), made(F.col("_most"), F.lit(0.4), F.concat(F.lit("Most files in same folder are categorised as "), F.col("_most")))),
        made(F.lit("Collection"), F.lit(0.0), F.lit("No better category found")),
    )
    return ours.join(votes, "source_dir", "left").select("file_id", out.alias("x")).select("file_id", "x.*")


def running_progress(records: DataFrame, by: list[str], order: list[str], size: str = "file_size") -> DataFrame:
    """records with files and bytes done so far, in order, by group. A group is spread over tasks; order must tell its
    rows apart."""
    return running(records, by, order, {"files_done": ("sum", F.lit(1)), "bytes_done": ("sum", F.coalesce(F.col(size), F.lit(0)))})


def session_rollup(records: DataFrame) -> DataFrame:
    """Files and bytes by session, type and category with subtotals."""
    return records.rollup("session_key", "file_type", "category").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.grouping_id().alias("level"))
