"""Queries over the catalogue operators and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.config import Config
from assetlake.functions import dates, media, paths
from assetlake.functions.ids import norm_hash, norm_id, phash_bits
from assetlake.functions.records import current_records, current_sessions
from assetlake.operators import dedup, destinations, grouping, review, scan, similarity
from assetlake.plans import reports
from assetlake.rules import ENCODER_WORDS
from assetlake.plans.assets import ASSETS_SQL, assets, table
from assetlake.plans.functions_q import EXT, HASH, ID, P, REASON_SQL, category_of, category_sql, in_list, label_sql, name, name_date_sql, sanitized, stem, type_sql

FIELDS = ("session_id", "source_path", "source_dir", "destination_path", "file_type", "category", "file_size", "sha256_hash", "perceptual_hash", "status", "skip_reason", "date_value", "date_source", "pair_policy", "exif_data", "created_at")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Current records with enum values in lower case."""
    r = current_records(table(spark, d, "file_records"), *FIELDS)
    low = lambda c: F.lower(F.trim(c)).alias(c)
    return r.select("file_id", norm_id("session_id").alias("session_key"), "source_path", "source_dir", "destination_path", low("file_type"), "category", "file_size",
        norm_hash("sha256_hash").alias("sha"), phash_bits("perceptual_hash").alias("bits"), low("status"), "skip_reason", "date_value", low("date_source"), low("pair_policy"), "exif_data", "created_at")


def groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "duplicate_groups")
    return g.groupBy(norm_id("id").alias("group_id")).agg(F.min(norm_id("session_id")).alias("session_key"), F.max("bytes_saved").alias("bytes_saved"), F.max("file_count").alias("file_count"))


def dedup_survivor(spark: SparkSession, d: str) -> DataFrame:
    return dedup.survivors(assets(spark, d), ["sha256_hash"]).select("file_id", "is_duplicate")


def dedup_arrival(spark: SparkSession, d: str) -> DataFrame:
    return dedup.arrival_duplicates(assets(spark, d), ["sha256_hash"], "arrival").select("file_id", "is_duplicate")


def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(assets(spark, d), ["session_id", "sha256_hash"])


def record_groups(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates among the records of each session, the shortest path surviving."""
    r = records(spark, d)
    key = F.struct(F.length("source_path").alias("n"), F.col("source_path").alias("p"), F.col("file_id").alias("i"))
    return dedup.duplicate_groups(r, ["session_key", "sha"], key=key)


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hashes").select(norm_hash("sha256_hash").alias("sha"))


def manifest_semi(spark: SparkSession, d: str) -> DataFrame:
    """Images of the catalogue that were accepted before."""
    return dedup.in_manifest(records(spark, d).where("file_type = 'image'"), _accepted(spark, d), "sha").select("file_id", "sha")


def manifest_anti(spark: SparkSession, d: str) -> DataFrame:
    """Current records whose content no accepted file has."""
    return dedup.not_in_manifest(records(spark, d), _accepted(spark, d), "sha").select("file_id", "sha")


def records_known(spark: SparkSession, d: str) -> DataFrame:
    """Current records whose content the manifest of accepted files holds."""
    h = table(spark, d, "hashes").select(norm_hash("sha256_hash").alias("sha"))
    return dedup.in_manifest(records(spark, d), h, "sha").select("file_id")


def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with one row a hash: rows added before 2022, then those after."""
    h = table(spark, d, "hashes").select(norm_hash("sha256_hash").alias("sha256_hash"), "rel_path", "file_size", "added_at")
    cut = F.col("added_at") < F.lit("2022-01-01").cast("timestamp")
    return dedup.merge_manifest(h.where(cut), h.where(~cut)).select("sha256_hash", F.unix_micros("added_at").alias("added_us"))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each path that scans have filed against the rows filed for it before."""
    m = table(spark, d, "source_manifest").select(F.col("file_path").alias("source_path"), "file_size", "mtime", "id").where("source_path is not null")
    last = m.groupBy("source_path").agg(F.max_by(F.struct("file_size", "mtime", "id"), "id").alias("l")).select("source_path", "l.*")
    before = m.join(last.select("id"), "id", "left_anti")
    return scan.changed_since(last, before).select("id", "change")


def rescan_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of the manifest's latest rows against those that were filed in the first half."""
    m = table(spark, d, "source_manifest")
    mid = m.agg(F.expr("(min(id) + max(id)) div 2").alias("mid"))
    late = m.join(F.broadcast(mid), F.col("id") > F.col("mid")).groupBy("file_path").agg(F.max_by(F.struct("file_size", "mtime"), "id").alias("m"))
    listing = late.select(F.col("file_path").alias("source_path"), "m.file_size", "m.mtime")
    early = m.join(F.broadcast(mid), F.col("id") <= F.col("mid")).select(F.col("file_path").alias("source_path"), "file_size", "mtime", "id")
    return scan.changed_since(listing, early).select("source_path", "change")


def scan_report(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_totals(scan.classified(assets(spark, d)))


def completed_anti(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return scan.not_completed(r, r.where("status = 'completed'")).select("file_id")


def pair_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    return grouping.raw_jpeg_pairs(assets(spark, d))


def pair_link(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d)
    return grouping.link_pairs(a, grouping.raw_jpeg_pairs(a)).where("pair_id is not null").select("file_id", "pair_id")


def warned(spark: SparkSession, d: str) -> DataFrame:
    """What a preview of the records warns of, with a million bytes free, and of the pairs of the assets."""
    r = records(spark, d)
    p = reports.space_check(reports.preview(r).withColumn("free", F.lit(1_000_000)), "estimated_bytes", "free")
    stubs = r.agg(F.count(paths.cloud_stub(P(), F.col("file_size"))).alias("cloud_stubs"))
    pairs = grouping.raw_jpeg_pairs(assets(spark, d)).agg(F.count(F.lit(1)).alias("unresolved_pairs"))
    return reports.preview_warnings(p.crossJoin(stubs).crossJoin(pairs))  # one row each


def space_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the records of each session fit into as many bytes as its library has accepted in all."""
    free = table(spark, d, "hashes").agg(F.sum("file_size").alias("free"))
    r = records(spark, d).groupBy("session_key").agg(F.sum("file_size").alias("bytes"))
    return reports.space_check(r.join(F.broadcast(free)), "bytes", "free").select("session_key", "required_bytes", "passes", "shortfall_bytes")


def saved_bytes(spark: SparkSession, d: str) -> DataFrame:
    return reports.duplicate_savings(reports.preview(records(spark, d))).select("duplicates_found", "saved_bytes")


def sidecar_plan(spark: SparkSession, d: str) -> DataFrame:
    """Where the sidecars of the assets' videos go."""
    to = assets(spark, d).select(P().alias("video_path"), F.concat(F.lit("/library/new-"), "file_id", F.lower(paths.extension(P()))).alias("destination_path"))
    return grouping.sidecar_copies(sidecar_match(spark, d), to)


def reclassify(spark: SparkSession, d: str) -> DataFrame:
    """Records after the sure suggestions of the review are taken."""
    r = records(spark, d)
    s = review_suggestions(spark, d).where("confidence > 0.5 and suggested <> 'Collection'").select("file_id", F.col("suggested").alias("category"))
    to = F.concat(F.lit("/library/"), "category", F.lit("/"), paths.basename(P()))
    return review.reclassified(r, s, to).select("file_id", "category", "destination_path")


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Records that a run couldn't copy, if those without a size are gone: not there, or without a destination."""
    seen = records(spark, d).where("file_size > 0").select("source_path")
    return review.stage_errors(records(spark, d).select("file_id", "source_path", "destination_path"), seen).where("stage_error is not null").select("file_id", "stage_error")


def tag_picks(spark: SparkSession, d: str) -> DataFrame:
    """Of each artist the most frequent genre, the first album and the first valid year by file."""
    a = table(spark, d, "audio").where("artist is not null").select("artist", "file_id", "album", "genre", "year").distinct()
    g = a.groupBy("artist", "genre").agg(F.count(F.lit(1)).alias("n"))
    tags = g.groupBy("artist").agg(F.sort_array(F.collect_list(F.struct(F.col("genre").alias("name"), F.col("n").alias("count")))).alias("tags"))
    rows = a.groupBy("artist").agg(F.sort_array(F.collect_list(F.struct("file_id", "album", F.col("year").cast("string").alias("year"), "genre"))).alias("rows"))
    j = tags.join(rows, "artist")
    return j.select("artist", media.top_tag(F.col("tags")).alias("genre"), media.first_named(F.col("rows"), "album").alias("album"), media.first_year(F.col("rows.year")).alias("year"))


def probed(spark: SparkSession, d: str) -> DataFrame:
    """The videos of the catalogue as a prober would print them, read back."""
    from assetlake.sources.media import probe_metadata

    v = table(spark, d, "video").distinct()
    text = lambda c: F.col(c).cast("string")
    tags = F.struct(F.col("make"), F.col("model").alias("com.apple.quicktime.model"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time"), F.when(F.col("has_location"), "+1+1/").alias("location"))
    streams = F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit("1").alias("width"), F.lit("1").alias("height"), F.struct(F.lit("x").alias("encoder")).alias("tags")), F.struct(F.lit("video").alias("codec_type"), text("width").alias("width"), text("height").alias("height"), F.struct("encoder").alias("tags")))
    doc = F.to_json(F.struct(F.struct(text("duration_seconds").alias("duration"), tags.alias("tags")).alias("format"), streams.alias("streams")))
    return v.select("file_id", probe_metadata(doc).alias("m")).select("file_id", "m.make", "m.model", "m.width", "m.height", "m.has_location", "m.date", "m.encoder").distinct()


def sidecar_match(spark: SparkSession, d: str) -> DataFrame:
    return grouping.sidecars(assets(spark, d))


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return assets(spark, d).select("*", dates.date_result(F.col("date_original"), P()).alias("r")).select("*", "r.date")


def burst_layered(spark: SparkSession, d: str) -> DataFrame:
    a = _shots(spark, d)
    found = grouping.bursts(a, media.camera_key(F.col("make"), F.col("model")), F.col("date"), F.col("has_location"), Config().burst_filename_patterns)
    return found.select("layer", "file_id", "burst_index")


def burst_time_layer(spark: SparkSession, d: str) -> DataFrame:
    """Events of a type within an hour, at least three, numbered."""
    e = table(spark, d, "events").select(F.col("event_id").alias("file_id"), "event_type", "ts", F.concat(F.lit("/e/"), "event_id").alias("source_path"))
    return grouping.burst_layer(e, [F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz")], 3, "time").select("file_id", "burst_index")


def date_tiers(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d).select("file_id", dates.date_result(F.col("date_original"), P(), F.when(F.col("file_id") % 3 == 0, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))).alias("r"))
    return a.select("file_id", "r.date", "r.source", "r.confidence")


def day_majority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.expr("event_id div 40").alias("folder"), F.to_date("ts").alias("day"))
    return reports.majority(e, ["folder"], "day").select("folder", "day", "n", "total")


def type_majority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return reports.majority(e, ["hour"], "event_type").select("hour", "event_type")


def neighbour_majority(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("status = 'completed' and category not in ('', 'Collection')")
    return reports.majority(r, ["source_dir"], "category", 0.2).select("source_dir", "category", "n")


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different perceptual hashes of current records within three bits, with how many files have each."""
    r = records(spark, d).where("bits is not null")
    n = r.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    p = similarity.similar_codes(r, 0.95)
    return p.join(n.select(F.col("bits").alias("code_a"), F.col("n").alias("files_a")), "code_a").join(n.select(F.col("bits").alias("code_b"), F.col("n").alias("files_b")), "code_b")


def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose 64 sign bits agree in three quarters."""
    bit = lambda k: F.when(F.get("embedding", k) > 0, F.shiftleft(F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))
    code = bit(0)
    for k in range(1, 64):
        code = code.bitwiseOR(bit(k))
    return similarity.similar_codes(table(spark, d, "embeddings").select(code.alias("bits")), 0.75)


def _destined(spark: SparkSession, d: str) -> DataFrame:
    a = _shots(spark, d).withColumn("category", category_of()).withColumn("file_type", paths.file_type_of(P()))
    return a.withColumn("dest_path", destinations.destination("/library", F.col("file_type"), F.col("category"), paths.stem(P()), paths.extension(P()), F.col("date"), F.col("make"), F.col("model")))


def dest_path(spark: SparkSession, d: str) -> DataFrame:
    return _destined(spark, d).select("file_id", "dest_path")


def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Files by extension only, so that all names of a type collide."""
    a = assets(spark, d).select("file_id", "arrival", F.concat(F.lit("/library/file"), F.lower(paths.extension(P()))).alias("dest_path"))
    return destinations.without_collisions(a, "dest_path", "arrival").select("file_id", "final_path")


def record_destinations(spark: SparkSession, d: str) -> DataFrame:
    """Names of records in a flat folder, against those that accepted files hold already."""
    r = records(spark, d).select("file_id", F.concat(F.lit("/flat/"), paths.basename(P())).alias("dest_path"))
    t = table(spark, d, "hashes").select(F.concat(F.lit("/flat/"), paths.basename(F.col("rel_path"))).alias("dest_path"))
    return destinations.without_collisions(r, "dest_path", "file_id", t).select("file_id", "final_path")


def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_stats(records(spark, d), groups(spark, d))


def preview_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.preview(records(spark, d))


def preview_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents as files, skipped, typed, hashed, deduplicated, categorised and counted."""
    return organized(spark, d).groupBy("category", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


def organized(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a run: every file with status, skip_reason and, for those to copy, destination."""
    a = _destined(spark, d).withColumn("reject", paths.reject_reason(P(), F.col("file_size")))
    kept = a.where("reject is null and file_type <> 'unknown'").select("file_id", "source_path", "mtime", "sha256_hash")
    dups = dedup.survivors(kept, ["sha256_hash"]).select("file_id", "is_duplicate")
    j = a.join(dups, "file_id", "left")
    reason = F.coalesce("reject", F.when(F.col("file_type") == "unknown", "unknown type"), F.when(F.col("is_duplicate"), "exact duplicate"))
    return j.select("file_id", "source_path", "file_type", "category", "file_size", reason.alias("skip_reason"), F.when(reason.isNull(), "completed").otherwise("skipped").alias("status"), F.when(reason.isNull(), F.col("dest_path")).alias("destination_path"))


def preview_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.skip_breakdown(organized(spark, d))


def record_categories(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_breakdown(records(spark, d))


def record_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.skip_breakdown(records(spark, d))


def detail_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.detail_rows(records(spark, d))


def space_check(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).groupBy("session_key").agg(F.sum("file_size").alias("bytes"))
    return r.select("session_key", reports.space_needed(F.col("bytes")).alias("required_bytes"))


def undo_verify(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "hashes").select(F.regexp_replace("rel_path", r"^\./", "").alias("path"), F.col("file_size").alias("bytes"))
    return reports.undo_check(records(spark, d), listing)


def review_suggestions(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("*", "exif_data.make", "exif_data.width", "exif_data.height")
    return reports.review_suggestions(r, Config().screenshot_resolutions, 10)


def high_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = review_suggestions(spark, d).where("confidence > 0.7 and suggested <> 'Collection'")
    return s.groupBy("suggested").agg(F.count(F.lit(1)).alias("files"))


def running_progress(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("session_key", "file_id", "file_size", "created_at")
    return reports.running_progress(r, ["session_key"], ["created_at", "file_id"]).select("file_id", "files_done", "bytes_done")


def history_listing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    best = s.groupBy(norm_id("id").alias("session_key")).agg(F.max_by(F.struct("created_at", "state", "source_dirs", "is_archived"), F.struct("updated_at", "created_at")).alias("s"))
    more = F.size("s.source_dirs") - 1
    first = paths.basename(F.regexp_replace(F.get("s.source_dirs", F.lit(0)), "/+$", ""))
    shown = F.when(more > 0, F.format_string("%s (+%d more)", first, more)).otherwise(first)
    return best.where("not coalesce(s.is_archived, false)").select("session_key", F.unix_micros("s.created_at").alias("created_us"), F.lower(F.trim("s.state")).alias("state"), shown.alias("folders")).orderBy(F.desc("created_us"))


def latest_resumable(spark: SparkSession, d: str) -> DataFrame:
    """Of each destination the latest session that was stopped or broke off."""
    s = table(spark, d, "sessions").where(norm_id("id").isNotNull()).groupBy(norm_id("id").alias("session_key")).agg(F.max_by(F.struct("destination_dir", "created_at", F.lower(F.trim("state")).alias("state")), F.struct("updated_at", "created_at")).alias("s"))
    some = s.select("session_key", "s.*").where("state in ('stopped', 'error')")
    return some.groupBy("destination_dir").agg(F.max_by(F.struct("session_key", "state"), F.struct("created_at", "session_key")).alias("l")).select("destination_dir", "l.*")


def transition_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of consecutive events of a user, counted."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.lag("event_type").over(w).alias("a"), F.col("event_type").alias("b"))
    return e.where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_rollup(records(spark, d))


def category_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    c = reports.category_breakdown(r)
    t = r.where("status = 'completed'").agg(F.sum("file_size").alias("b"), F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(t)).select("category", "files", F.floor(F.col("files") * (F.col("b") / F.col("n"))).cast("bigint").alias("bytes"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The hashes that a stream of the records accepts, whatever batches it falls into."""
    from assetlake.runtime import scratch_dir
    from assetlake.streaming import ingest

    root = scratch_dir(spark, "stream")
    source = table(spark, d, "file_records")
    ingest.start_ingest(spark, f"{d}/file_record[s].parquet", source.schema, root).awaitTermination()
    return ingest.accepted(spark, root).select("sha256_hash")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from assetlake.streaming import ingest

    return ingest.events_per_window(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 3).alias("total"))


QUERIES = {f.__name__: f for f in (
    stream_ingest, event_windows, dedup_survivor, dedup_arrival, dedup_groups, record_groups, manifest_semi, manifest_anti, records_known, manifest_merge, incremental_diff, rescan_diff, scan_report,
    completed_anti, pair_exactly_one, pair_link, warned, space_shortfall, saved_bytes, sidecar_plan, reclassify, staged, tag_picks, probed, sidecar_match, burst_layered, burst_time_layer, date_tiers, day_majority, type_majority,
    neighbour_majority, similar_pairs, similar_vectors, dest_path, collision_suffix, record_destinations, session_stats, preview_summary, preview_by_category, organized,
    preview_skip_reasons, record_categories, record_skip_reasons, detail_report, space_check, undo_verify, review_suggestions, high_confidence, running_progress,
    history_listing, latest_resumable, transition_audit, session_rollup, category_size_estimate)}

# --- SQL ---------------------------------------------------------------------------------------------------------

_A = f"WITH {ASSETS_SQL}"
_SURVIVES = "row(length(source_path), mtime, source_path)"
RECORDS = f"""
rr AS (SELECT *, {ID.format("id")} AS file_id, row_number() OVER (PARTITION BY {ID.format("id")} ORDER BY pipeline_stage DESC, created_at DESC) AS rn FROM file_records),
records AS (
  SELECT file_id, {ID.format("session_id")} AS session_key, source_path, source_dir, destination_path, lower(trim(file_type)) AS file_type, category, file_size,
    {HASH.format("sha256_hash")} AS sha, regexp_replace(lower(trim(perceptual_hash)), '^(phash[:=]\\s*)?(0x)?', '') AS ph, lower(trim(status)) AS status, skip_reason, date_value,
    lower(trim(date_source)) AS date_source, lower(trim(pair_policy)) AS pair_policy, exif_data, created_at
  FROM rr WHERE rn = 1 AND file_id IS NOT NULL)"""
_R = f"WITH {RECORDS}"


def _pairs(source: str, path: str = "source_path") -> str:
    from assetlake import rules

    raw, jpeg = in_list(rules.dotted(rules.RAW)), in_list(rules.dotted(rules.JPEG))
    e = f"lower({EXT.format(path)})"
    return f"""SELECT max({path}) FILTER ({e} IN {raw}) AS raw_path, max({path}) FILTER ({e} IN {jpeg}) AS jpeg_path, lower({stem(path)}) AS stem
FROM {source} GROUP BY regexp_replace(source_dir, '/+$', ''), lower({stem(path)}) HAVING count(*) FILTER ({e} IN {raw}) = 1 AND count(*) FILTER ({e} IN {jpeg}) = 1"""


_TIER = f"""tier AS (SELECT *, {name_date_sql(f"{name('source_path')}")} AS nd FROM assets),
dated AS (SELECT *, CASE WHEN date_original IS NOT NULL THEN date_original ELSE nd.date END AS date FROM tier)"""
_CAT = category_sql()
_DEST = f"""{_TIER}, c AS (SELECT *, {type_sql("source_path")} AS file_type, {_CAT} AS category, coalesce(strftime(date, '%Y'), '0000') AS year,
  {label_sql("make", "model")} AS label FROM dated),
x AS (SELECT *, CASE WHEN file_type = 'document' THEN regexp_replace(category, '^Documents/', '') ELSE category END AS inner_cat,
  CASE WHEN category = 'Originals' THEN {sanitized(f"({stem('source_path')} || {EXT.format('source_path')})")}
  ELSE {sanitized(f"(concat_ws(' -- ', strftime(date, '%Y-%m-%d %H-%M-%S'), label, {stem('source_path')}) || {EXT.format('source_path')})")} END AS fname FROM c),
dest AS (SELECT *, concat_ws('/', '/library', CASE file_type WHEN 'image' THEN 'Images' WHEN 'video' THEN 'Videos' WHEN 'audio' THEN 'Audio' WHEN 'document' THEN 'Documents' END,
  CASE WHEN inner_cat IN ('Originals', 'RAW', 'Camera') THEN concat_ws('/', inner_cat, label, year)
    WHEN inner_cat IN ('Edited', 'Export', 'Motion Photos', 'Voice Notes', 'WhatsApp', 'Call Recordings', 'Mobile', 'Camcorder', 'Clips') THEN inner_cat || '/' || year ELSE inner_cat END, fname) AS dest_path FROM x)"""
_ORG = f"""{_DEST}, rej AS (SELECT *, {REASON_SQL} AS reject FROM dest),
keep AS (SELECT file_id, row_number() OVER (PARTITION BY sha256_hash ORDER BY length(source_path), mtime, source_path) AS n FROM rej WHERE reject IS NULL AND file_type <> 'unknown'),
org AS (SELECT r.*, coalesce(reject, CASE WHEN file_type = 'unknown' THEN 'unknown type' END, CASE WHEN k.n > 1 AND sha256_hash IS NOT NULL THEN 'exact duplicate' END) AS skip_reason FROM rej r LEFT JOIN keep k USING (file_id))"""
_G = f"g AS (SELECT {ID.format('id')} AS group_id, min({ID.format('session_id')}) AS session_key, max(bytes_saved) AS bytes_saved FROM duplicate_groups GROUP BY 1)"
_SOCIAL = "CASE " + " ".join(f"WHEN starts_with({name('source_path')}, '{p}') THEN '{p}'" for p in ("IMG-", "VID-", "FB_IMG_", "FB_VID_", "Screenshot_", "signal-", "Telegram")) + " END"


def _review() -> str:
    from assetlake.plans.functions_q import screen_sql

    folder = "regexp_extract(regexp_extract(source_path, '(?s)^(.*)/[^/]*$', 1), '([^/]*)$', 1)"
    by_name, by_folder = name_date_sql(stem("source_path")), name_date_sql(folder)
    return f"""{_R}, votes AS (SELECT source_dir, category, count(*) AS n FROM records WHERE status = 'completed' AND category NOT IN ('', 'Collection') GROUP BY ALL),
most AS (SELECT source_dir, arg_max(category, row(n, category)) AS most FROM votes GROUP BY 1 HAVING max(n) > sum(n) * 0.5),
q AS (SELECT r.*, most, {_SOCIAL} AS social, {by_name} AS dn, {by_folder} AS df, file_type = 'image' AND exif_data.make IS NOT NULL AS cam,
  file_type = 'image' AND {screen_sql("exif_data.width", "exif_data.height")} AS scr FROM records r LEFT JOIN most USING (source_dir) WHERE category = 'Collection' AND status = 'completed'),
review AS (SELECT file_id,
  CASE WHEN cam THEN 'Originals' WHEN scr THEN 'Screenshots' WHEN social IS NOT NULL THEN 'Social Media' WHEN dn IS NOT NULL OR df IS NOT NULL THEN 'Export' ELSE coalesce(most, 'Collection') END AS suggested,
  CASE WHEN cam THEN 0.9::DOUBLE WHEN scr OR social IS NOT NULL THEN 0.7::DOUBLE WHEN dn IS NOT NULL THEN dn.confidence WHEN df IS NOT NULL THEN df.confidence * 0.75 WHEN most IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN cam THEN 'Camera metadata found: ' || exif_data.make WHEN scr THEN 'Dimensions match common screenshot resolution' WHEN social IS NOT NULL THEN 'Filename matches social media pattern: ' || social || '*'
    WHEN dn IS NOT NULL OR df IS NOT NULL THEN 'Date found in filename' WHEN most IS NOT NULL THEN 'Most files in same folder are categorised as ' || most ELSE 'No better category found' END AS reason FROM q)"""


_DONE = "status = 'completed'"
_STUBS = f"WHEN suffix(source_path, '.icloud') OR suffix(source_path, '.cloud') OR suffix(source_path, '.odopen') OR suffix(source_path, '.dropbox') OR suffix(source_path, '.dropbox.attr') OR (lower({EXT.format('source_path')}) IN ('.gdoc', '.gsheet', '.gslides') AND file_size = 0) THEN 1"
_RUNS = "lower(trim(state)) AS state, row_number() OVER (PARTITION BY {id} ORDER BY updated_at DESC, created_at DESC) AS rn"

SQL = {
    "manifest_semi": f"{_R} SELECT file_id, sha FROM records WHERE file_type = 'image' AND sha IN (SELECT {HASH.format('sha256_hash')} FROM hashes WHERE sha256_hash IS NOT NULL)",
    "manifest_anti": f"{_R}, h AS (SELECT DISTINCT {HASH.format('sha256_hash')} AS h FROM hashes) SELECT file_id, sha FROM records LEFT JOIN h ON sha = h WHERE h IS NULL",
    "incremental_diff": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id DESC) AS rn FROM source_manifest WHERE file_path IS NOT NULL),
j AS (SELECT l.id, b.id AS old, l.file_size AS z, b.file_size AS bz, l.mtime AS t, b.mtime AS bt FROM m l LEFT JOIN m b ON b.file_path = l.file_path AND b.rn = 2 WHERE l.rn = 1)
SELECT id, CASE WHEN old IS NULL THEN 'new' WHEN z IS DISTINCT FROM bz THEN 'size' ELSE 'mtime' END AS change FROM j WHERE old IS NULL OR z IS DISTINCT FROM bz OR t IS DISTINCT FROM bt""",
    "pair_link": f"{_A}, p AS ({_pairs('assets')}), j AS (SELECT r.file_id AS r, q.file_id AS q FROM p JOIN assets r ON r.source_path = raw_path JOIN assets q ON q.source_path = jpeg_path) SELECT r AS file_id, q AS pair_id FROM j UNION ALL SELECT q, r FROM j",
    "warned": f"""{_A}, {RECORDS}, p AS ({_pairs('assets')}),
f AS (SELECT count(*) AS t, count(*) FILTER ({_DONE}) AS c, count(*) FILTER (status = 'skipped' AND skip_reason = 'exact duplicate') AS dup, count(*) FILTER (date_source = 'inferred') AS inf,
  CAST(ceil(CAST(sum(file_size) FILTER ({_DONE}) AS BIGINT) * 1.3::DOUBLE * 1.1::DOUBLE) AS BIGINT) - 1000000 AS lack, count(CASE {_STUBS} END) AS stubs, (SELECT count(*) FROM p) AS pairs FROM records)
SELECT 0 AS n, printf('Insufficient disk space: %.1f MB shortfall', lack / 1048576.0::DOUBLE) AS warning FROM f WHERE lack > 0
UNION ALL SELECT 1, printf('High duplicate ratio: %.0f%% of files are duplicates', dup * 100.0::DOUBLE / t) FROM f WHERE dup * 2 > t
UNION ALL SELECT 2, printf('%d files have inferred dates (%.0f%% of files to copy)', inf, inf * 100.0::DOUBLE / c) FROM f WHERE inf * 4 > c
UNION ALL SELECT 3, printf('%d cloud stub(s) detected — files may not be downloaded locally', stubs) FROM f WHERE stubs > 0
UNION ALL SELECT 4, printf('%d RAW+JPEG pair(s) have no pair policy set', pairs) FROM f WHERE pairs > 0""",
    "space_shortfall": f"{_R}, r AS (SELECT session_key, CAST(ceil(CAST(coalesce(sum(file_size), 0) AS BIGINT) * 1.3::DOUBLE * 1.1::DOUBLE) AS BIGINT) AS need, (SELECT CAST(sum(file_size) AS BIGINT) FROM hashes) AS free FROM records GROUP BY 1) SELECT session_key, need AS required_bytes, need <= free AS passes, greatest(need - free, 0) AS shortfall_bytes FROM r",
    "saved_bytes": f"{_R}, f AS (SELECT count(*) FILTER (status = 'skipped' AND skip_reason = 'exact duplicate') AS dup, count(*) FILTER ({_DONE}) AS c, CAST(sum(file_size) FILTER ({_DONE}) AS BIGINT) AS b FROM records) SELECT dup AS duplicates_found, CAST(CASE WHEN dup > 0 AND c > 0 AND b > 0 THEN floor(dup * (b::DOUBLE / c)) ELSE 0 END AS BIGINT) AS saved_bytes FROM f",
    "sidecar_plan": f"""{_A}, f AS (SELECT file_id, source_path, regexp_extract(source_path, '(?s)^(.*)/[^/]*$', 1) AS dir, {name("source_path")} AS own, lower({stem("source_path")}) AS s, {EXT.format("source_path")} AS e FROM assets),
j AS (SELECT DISTINCT v.source_path AS video_path, c.source_path AS sidecar_path, v.file_id, v.own AS vn, v.e AS ve, c.own AS cn, c.e AS ce FROM f v JOIN f c ON v.dir = c.dir AND (v.s = c.s OR starts_with(lower(c.own), lower(v.own)))
  WHERE lower(v.e) IN {in_list(["." + x for x in "mp4 mov avi mkv wmv flv webm m4v mpg mpeg 3gp 3g2 mts m2ts ts vob ogv divx asf rm rmvb f4v".split()])} AND lower(c.e) IN ('.thm', '.srt', '.sub', '.lrc', '.xmp', '.aae'))
SELECT video_path, sidecar_path, '/library/new-' || file_id || CASE WHEN starts_with(lower(cn), lower(vn)) THEN ve || substr(cn, length(vn) + 1) ELSE ce END AS destination_path FROM j""",
    "reclassify": f"{_review()} SELECT r.file_id, coalesce(CASE WHEN confidence > 0.5 AND suggested <> 'Collection' THEN suggested END, r.category) AS category, CASE WHEN confidence > 0.5 AND suggested <> 'Collection' THEN '/library/' || suggested || '/' || {name('source_path')} ELSE destination_path END AS destination_path FROM records r LEFT JOIN review USING (file_id)",
    "staged": f"{_R}, m AS (SELECT DISTINCT source_path AS file_path FROM records WHERE file_size > 0) SELECT file_id, CASE WHEN file_path IS NULL THEN 'file not found: ' || coalesce(source_path, '') ELSE 'no destination path' END AS stage_error FROM records LEFT JOIN m ON source_path = file_path WHERE file_path IS NULL OR coalesce(destination_path, '') = ''",
    "tag_picks": """WITH a AS (SELECT DISTINCT artist, file_id, album, genre, year FROM audio WHERE artist IS NOT NULL),
g AS (SELECT artist, genre, count(*) AS n FROM a WHERE coalesce(genre, '') <> '' GROUP BY ALL), t AS (SELECT artist, genre FROM g QUALIFY row_number() OVER (PARTITION BY artist ORDER BY n DESC, genre) = 1),
o AS (SELECT *, row(file_id, coalesce(album, ''), coalesce(CAST(year AS VARCHAR), ''), coalesce(genre, '')) AS k FROM a)
SELECT o.artist, any_value(t.genre) AS genre, arg_min(album, k) FILTER (coalesce(album, '') <> '') AS album, arg_min(year, k) FILTER (year BETWEEN 1900 AND 2100) AS year FROM o LEFT JOIN t USING (artist) GROUP BY o.artist""",
    "probed": f"""WITH v AS (SELECT DISTINCT file_id, nullif(trim(make), '') AS make, nullif(trim(model), '') AS model, width, height, coalesce(has_location, false) AS has_location, date_trunc('second', date) AS date, nullif(trim(encoder), '') AS encoder FROM video),
c AS (SELECT *, coalesce(regexp_matches(lower(make), '{"|".join(ENCODER_WORDS)}'), false) OR coalesce(regexp_matches(lower(model), '{"|".join(ENCODER_WORDS)}'), false) AS coded FROM v)
SELECT DISTINCT file_id, CASE WHEN NOT coded THEN make END AS make, CASE WHEN NOT coded THEN model END AS model, width, height, has_location, date, encoder FROM c""",
    "latest_resumable": f"WITH s AS (SELECT {ID.format('id')} AS session_key, destination_dir, created_at, {_RUNS.format(id=ID.format('id'))} FROM sessions) SELECT destination_dir, session_key, state FROM s WHERE rn = 1 AND session_key IS NOT NULL AND state IN ('stopped', 'error') QUALIFY row_number() OVER (PARTITION BY destination_dir ORDER BY created_at DESC, session_key DESC) = 1",
    "stream_ingest": f"{_R} SELECT DISTINCT sha AS sha256_hash FROM records WHERE sha IS NOT NULL",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "dedup_survivor": f"{_A} SELECT file_id, row_number() OVER (PARTITION BY sha256_hash ORDER BY length(source_path), mtime, source_path) > 1 AND sha256_hash IS NOT NULL AS is_duplicate FROM assets",
    "dedup_arrival": f"{_A} SELECT a.file_id, a.sha256_hash IS NOT NULL AND EXISTS (SELECT 1 FROM assets b WHERE b.sha256_hash = a.sha256_hash AND b.arrival < a.arrival AND row(length(b.source_path), b.mtime, b.source_path) <= row(length(a.source_path), a.mtime, a.source_path)) AS is_duplicate FROM assets a",
    "dedup_groups": f"{_A} SELECT session_id, sha256_hash, arg_min(file_id, row(length(source_path), mtime, source_path, file_id)) AS winner_file_id, count(*) AS file_count, CAST(sum(file_size) - arg_min(file_size, row(length(source_path), mtime, source_path, file_id)) AS BIGINT) AS bytes_saved FROM assets WHERE sha256_hash IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "record_groups": f"{_R} SELECT session_key, sha, arg_min(file_id, row(length(source_path), source_path, file_id)) AS winner_file_id, count(*) AS file_count, CAST(sum(file_size) - arg_min(file_size, row(length(source_path), source_path, file_id)) AS BIGINT) AS bytes_saved FROM records WHERE sha IS NOT NULL AND session_key IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "records_known": f"{_R} SELECT file_id FROM records WHERE sha IN (SELECT {HASH.format('sha256_hash')} FROM hashes WHERE sha256_hash IS NOT NULL)",
    "manifest_merge": f"SELECT {HASH.format('sha256_hash')} AS sha256_hash, epoch_us(max(added_at)) AS added_us FROM hashes WHERE added_at IS NOT NULL AND {HASH.format('sha256_hash')} IS NOT NULL GROUP BY 1",
    "rescan_diff": """WITH mid AS (SELECT (min(id) + max(id)) // 2 AS mid FROM source_manifest),
late AS (SELECT file_path, arg_max(row(file_size, mtime), id) AS v FROM source_manifest, mid WHERE id > mid GROUP BY 1),
early AS (SELECT file_path, arg_max(row(file_size, mtime), id) AS w FROM source_manifest, mid WHERE id <= mid GROUP BY 1)
SELECT file_path AS source_path, CASE WHEN w IS NULL THEN 'new' WHEN v[1] IS DISTINCT FROM w[1] THEN 'size' ELSE 'mtime' END AS change
FROM late LEFT JOIN early USING (file_path) WHERE w IS NULL OR v[1] IS DISTINCT FROM w[1] OR v[2] IS DISTINCT FROM w[2]""",
    "scan_report": f"{_A} SELECT coalesce({REASON_SQL}, 'kept') AS reject_reason, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM assets GROUP BY 1",
    "completed_anti": f"{_R} SELECT file_id FROM records WHERE source_path NOT IN (SELECT source_path FROM records WHERE status = 'completed' AND source_path IS NOT NULL)",
    "pair_exactly_one": f"{_A} {_pairs('assets')}",
    "sidecar_match": f"""{_A}, f AS (SELECT source_path, regexp_extract(source_path, '(?s)^(.*)/[^/]*$', 1) AS dir, lower({name("source_path")}) AS n, lower({stem("source_path")}) AS s, lower({EXT.format("source_path")}) AS e FROM assets)
SELECT DISTINCT v.source_path AS video_path, c.source_path AS sidecar_path FROM f v JOIN f c ON v.dir = c.dir AND (v.s = c.s OR starts_with(c.n, v.n))
WHERE v.e IN ('.mp4', '.mov', '.avi', '.mkv', '.wmv', '.flv', '.webm', '.m4v', '.mpg', '.mpeg', '.3gp', '.3g2', '.mts', '.m2ts', '.ts', '.vob', '.ogv', '.divx', '.asf', '.rm', '.rmvb', '.f4v') AND c.e IN ('.thm', '.srt', '.sub', '.lrc', '.xmp', '.aae')""",
    "burst_layered": f"""{_A}, {_TIER}, s AS (SELECT file_id, source_path, date, date_trunc('second', date) AS sec, has_location AS flagged, {stem("source_path")} AS st, lower({name("source_path")}) AS nm,
  CASE WHEN coalesce(make, '') = '' THEN nullif(model, '') WHEN coalesce(model, '') = '' THEN make WHEN starts_with(lower(model), lower(make)) THEN model ELSE make || ' - ' || model END AS cam FROM dated),
l1 AS (SELECT *, count(*) OVER (PARTITION BY cam, sec) AS n FROM s WHERE flagged), b1 AS (SELECT file_id, 'exif' AS layer, row_number() OVER (PARTITION BY cam, sec ORDER BY nm, file_id) - 1 AS burst_index FROM l1 WHERE n >= 2),
s2 AS (SELECT * FROM s WHERE file_id NOT IN (SELECT file_id FROM b1)),
l2 AS (SELECT *, lower(coalesce(nullif(regexp_extract(st, '^(.+?)[_\\-](?:BURST|BRACKETED|burst|bracketed)\\d*', 1), ''), st)) AS pre FROM s2 WHERE st GLOB '*_BURST*' OR st GLOB '*_BRACKETED*'),
c2 AS (SELECT *, count(*) OVER (PARTITION BY pre, cam) AS n FROM l2), b2 AS (SELECT file_id, 'name' AS layer, row_number() OVER (PARTITION BY pre, cam ORDER BY nm, file_id) - 1 AS burst_index FROM c2 WHERE n >= 2),
c3 AS (SELECT *, count(*) OVER (PARTITION BY cam, sec) AS n FROM s2 WHERE date IS NOT NULL AND file_id NOT IN (SELECT file_id FROM b2)), b3 AS (SELECT file_id, 'time' AS layer, row_number() OVER (PARTITION BY cam, sec ORDER BY nm, file_id) - 1 AS burst_index FROM c3 WHERE n >= 3)
SELECT layer, file_id, burst_index FROM b1 UNION ALL SELECT layer, file_id, burst_index FROM b2 UNION ALL SELECT layer, file_id, burst_index FROM b3""",
    "burst_time_layer": "WITH e AS (SELECT event_id, event_type, date_trunc('hour', ts) AS h FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY event_type, h) AS n FROM e) SELECT event_id AS file_id, row_number() OVER (PARTITION BY event_type, h ORDER BY CAST(event_id AS VARCHAR), event_id) - 1 AS burst_index FROM c WHERE n >= 3",
    "date_tiers": f"""{_A}, tier AS (SELECT *, {name_date_sql(f"{name('source_path')}")} AS nd FROM assets) SELECT file_id,
  coalesce(date_original, nd.date, CASE WHEN file_id % 3 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END) AS date,
  CASE WHEN date_original IS NOT NULL THEN 'metadata' WHEN nd IS NOT NULL THEN 'parsed' WHEN file_id % 3 = 0 THEN 'inferred' ELSE 'none' END AS source,
  CASE WHEN date_original IS NOT NULL THEN 1.0::DOUBLE WHEN nd IS NOT NULL THEN nd.confidence WHEN file_id % 3 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM tier""",
    "day_majority": "WITH c AS (SELECT event_id // 40 AS folder, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT folder, arg_max(day, row(n, day)) AS day, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY folder HAVING max(n) > sum(n) * 0.5",
    "type_majority": "WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT hour, arg_max(event_type, row(n, event_type)) AS event_type FROM c GROUP BY hour HAVING max(n) > sum(n) * 0.5",
    "neighbour_majority": f"{_R}, c AS (SELECT source_dir, category, count(*) AS n FROM records WHERE status = 'completed' AND category NOT IN ('', 'Collection') GROUP BY ALL) SELECT source_dir, arg_max(category, row(n, category)) AS category, max(n) AS n FROM c GROUP BY 1 HAVING max(n) > sum(n) * 0.2",
    "similar_pairs": f"""{_R}, n AS (SELECT (CASE WHEN regexp_full_match(ph, '[0-9a-f]{{1,16}}') THEN ('0x' || ph)::UBIGINT END)::HUGEINT - CASE WHEN length(ph) = 16 AND ph >= '8' THEN 18446744073709551616::HUGEINT ELSE 0 END AS b, count(*) AS n FROM records WHERE regexp_full_match(ph, '[0-9a-f]{{1,16}}') GROUP BY 1),
x AS (SELECT b::BIGINT AS b, n FROM n)
SELECT a.b AS code_a, c.b AS code_b, 1 - bit_count(xor(a.b, c.b)) / 64.0::DOUBLE AS similarity, a.n AS files_a, c.n AS files_b FROM x a JOIN x c ON a.b < c.b AND bit_count(xor(a.b, c.b)) <= 3""",
    "similar_vectors": """WITH e AS (SELECT DISTINCT list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings),
c AS (SELECT s, CAST(list_sum([CAST(s[i] AS HUGEINT) * CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i - 1)) END for i in range(1, 65)]) AS BIGINT) AS b FROM e)
SELECT x.b AS code_a, y.b AS code_b, 1 - bit_count(xor(x.b, y.b)) / 64.0::DOUBLE AS similarity FROM c x JOIN c y ON x.b < y.b AND bit_count(xor(x.b, y.b)) <= 16""",
    "dest_path": f"{_A}, {_DEST} SELECT file_id, dest_path FROM dest",
    "collision_suffix": f"{_A}, n AS (SELECT file_id, lower({EXT.format('source_path')}) AS e, row_number() OVER (PARTITION BY lower({EXT.format('source_path')}) ORDER BY arrival) AS n FROM assets) SELECT file_id, '/library/file' || CASE WHEN n = 1 THEN '' ELSE '-' || CAST(n - 1 AS VARCHAR) END || e AS final_path FROM n",
    "session_stats": f"{_R}, {_G}, a AS (SELECT session_key, count(*) FILTER (status = 'completed') AS files_processed, count(*) FILTER (status = 'skipped') AS files_skipped, count(*) FILTER (status = 'error') AS files_errored FROM records GROUP BY 1), b AS (SELECT session_key, count(*) AS dupes_found, CAST(sum(bytes_saved) AS BIGINT) AS space_saved FROM g GROUP BY 1) SELECT a.session_key, files_processed, files_skipped, files_errored, coalesce(dupes_found, 0) AS dupes_found, coalesce(space_saved, 0) AS space_saved FROM a LEFT JOIN b USING (session_key)",
    "preview_summary": f"{_R} SELECT count(*) AS total_files, count(*) FILTER (status = 'completed') AS files_to_copy, count(*) FILTER (status IN ('skipped', 'error')) AS files_to_skip, count(*) FILTER (status = 'skipped' AND skip_reason = 'exact duplicate') AS duplicates_found, CAST(coalesce(sum(file_size) FILTER (status = 'completed'), 0) AS BIGINT) AS estimated_bytes, count(*) FILTER (date_source = 'inferred') AS inferred_dates FROM records",
    "preview_by_category": f"{_A}, {_ORG} SELECT category, CASE WHEN skip_reason IS NULL THEN 'completed' ELSE 'skipped' END AS status, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM org GROUP BY 1, 2",
    "organized": f"{_A}, {_ORG} SELECT file_id, source_path, file_type, category, file_size, skip_reason, CASE WHEN skip_reason IS NULL THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN skip_reason IS NULL THEN dest_path END AS destination_path FROM org",
    "preview_skip_reasons": f"{_A}, {_ORG} SELECT skip_reason AS reason, count(*) AS files FROM org WHERE skip_reason IS NOT NULL GROUP BY 1",
    "record_categories": f"{_R} SELECT category, count(*) AS files FROM records WHERE status = 'completed' AND category <> '' GROUP BY 1",
    "record_skip_reasons": f"{_R} SELECT CASE WHEN status = 'error' THEN 'error' ELSE coalesce(skip_reason, 'unknown') END AS reason, count(*) AS files FROM records WHERE status IN ('skipped', 'error') GROUP BY 1",
    "detail_report": f"{_R} SELECT source_path, coalesce(destination_path, '') AS destination_path, CASE WHEN status = 'completed' THEN 'copy' WHEN status = 'skipped' AND skip_reason = 'exact duplicate' THEN 'duplicate' WHEN status = 'skipped' THEN 'skip' ELSE 'error' END AS action, category, file_type, coalesce(date_value, '') AS date_value, date_source, file_size, CASE WHEN date_source = 'inferred' THEN 'inferred date' ELSE '' END AS warnings FROM records",
    "space_check": f"{_R} SELECT session_key, CAST(ceil(CAST(sum(file_size) AS BIGINT) * 1.3::DOUBLE * 1.1::DOUBLE) AS BIGINT) AS required_bytes FROM records GROUP BY 1",
    "undo_verify": f"{_R}, l AS (SELECT regexp_replace(rel_path, '^\\./', '') AS path, max(file_size) AS b FROM hashes GROUP BY 1), a AS (SELECT session_key, count(*) AS t, count(path) AS p, CAST(coalesce(sum(b), 0) AS BIGINT) AS f FROM records LEFT JOIN l ON destination_path = path WHERE status = 'completed' AND destination_path <> '' GROUP BY 1) SELECT session_key, t AS total_files, p AS files_present, t - p AS files_missing, f AS bytes_to_free, p * 10 >= t * 9 AS safe_to_proceed FROM a",
    "review_suggestions": f"{_review()} SELECT * FROM review",
    "high_confidence": f"{_review()} SELECT suggested, count(*) AS files FROM review WHERE confidence > 0.7 AND suggested <> 'Collection' GROUP BY 1",
    "running_progress": f"{_R} SELECT file_id, count(*) OVER w AS files_done, CAST(sum(coalesce(file_size, 0)) OVER w AS BIGINT) AS bytes_done FROM records WINDOW w AS (PARTITION BY session_key ORDER BY created_at, file_id ROWS UNBOUNDED PRECEDING)",
    "history_listing": f"WITH s AS (SELECT {ID.format('id')} AS session_key, arg_max(row(created_at, state, source_dirs, is_archived), row(updated_at, created_at)) AS s FROM sessions GROUP BY 1), x AS (SELECT session_key, epoch_us(s[1]) AS created_us, lower(trim(s[2])) AS state, len(s[3]) - 1 AS more, regexp_extract(regexp_replace(s[3][1], '/+$', ''), '([^/]*)$', 1) AS f FROM s WHERE NOT coalesce(s[4], false)) SELECT session_key, created_us, state, CASE WHEN more > 0 THEN printf('%s (+%d more)', f, more) ELSE f END AS folders FROM x",
    "transition_audit": "WITH e AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) SELECT a, b, count(*) AS n FROM e WHERE a IS NOT NULL GROUP BY 1, 2",
    "session_rollup": f"{_R} SELECT session_key, file_type, category, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(grouping_id(session_key, file_type, category) AS BIGINT) AS level FROM records GROUP BY ROLLUP (session_key, file_type, category)",
    "category_size_estimate": f"{_R}, t AS (SELECT CAST(sum(file_size) AS DOUBLE) / count(*) AS avg FROM records WHERE status = 'completed') SELECT category, count(*) AS files, CAST(floor(count(*) * any_value(avg)) AS BIGINT) AS bytes FROM records, t WHERE status = 'completed' AND category <> '' GROUP BY 1",
}
