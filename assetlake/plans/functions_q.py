"""Queries over the column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake import rules
from assetlake.config import Config
from assetlake.functions import dates, fmt, ids, media, paths
from assetlake.operators import categorize, detect
from assetlake.plans.assets import ASSETS_SQL, assets, table

def P():  # noqa: N802
    return F.col("source_path")


def ext_split(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").select("source_path").distinct()
    return f.select(P().alias("source_path"), paths.basename(P()).alias("name"), paths.stem(P()).alias("stem"), paths.extension(P()).alias("ext"), paths.parent_name(P()).alias("folder"))


def ext_to_type(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "source_manifest").select(F.col("file_path").alias("source_path"))
    return m.groupBy(paths.file_type_of(P()).alias("file_type"), paths.mime_of(P()).alias("mime")).agg(F.count(F.lit(1)).alias("files"))


def glob_match(spark: SparkSession, d: str) -> DataFrame:
    name = paths.basename(P())
    globs = {"social": Config().social_media_image_patterns, "shots": Config().screenshot_filename_patterns, "calls": Config().call_recording_patterns}
    f = table(spark, d, "file_records").select("source_path").unionByName(assets(spark, d).select("source_path")).distinct()
    return f.select("source_path", *(rules.any_glob(name, g).alias(k) for k, g in globs.items()))


def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audio").select("title").where("title is not null").distinct().select("title", paths.sanitize(F.col("title")).alias("safe"))


def sha256_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


def normal_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").select(ids.norm_id("id").alias("file_id"), ids.norm_hash("sha256_hash").alias("sha")).distinct()


def make_model(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "exif").select("make", "model").distinct()
    a, b = F.col("make"), F.col("model")
    return e.select("make", "model", media.make_model_label(a, b).alias("label"), media.camera_key(a, b).alias("camera"))


def fmt_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hashes").select("file_size").where("file_size is not null").distinct().select("file_size", fmt.fmt_bytes(F.col("file_size")).alias("shown"))


def fmt_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video").select("duration_seconds").where("duration_seconds is not null").distinct().select("duration_seconds", fmt.fmt_duration(F.col("duration_seconds")).alias("shown"))


def parse_name_date(spark: SparkSession, d: str) -> DataFrame:
    f = assets(spark, d).select("source_path").unionByName(table(spark, d, "file_records").select("source_path")).distinct()
    r = dates.name_date(paths.stem(P()), 0.8)
    return f.select("source_path", r["date"].alias("date"), r["confidence"].alias("confidence"))


def exif_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "exif").select("date_digitized").where("date_digitized is not null").distinct()
    return e.select("date_digitized", dates.exif_date(F.col("date_digitized")).alias("date"))


def gps_decimal(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    rational = lambda n, den: F.struct(n.cast("bigint").alias("num"), den.cast("bigint").alias("den"))
    k = F.col("o_orderkey")
    dec = media.gps_decimal(rational(k % 180, F.lit(1)), rational(k % 600, F.lit(10)), rational(k % 6000, k % 3 * 100), F.when(k % 2 == 0, "N").otherwise("S"))
    return o.select("o_orderkey", F.round(dec, 9).alias("degrees"))


def display_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "exif").select("width", "height").unionByName(assets(spark, d).select("width", "height")).distinct()
    w, h = F.col("width"), F.col("height")
    return e.select("width", "height", media.display_ratio(w, h).alias("ratio"), media.screenshot_size(w, h, Config().screenshot_resolutions, 10).alias("screen"))


def fit_size(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "exif").select("width", "height", "orientation").where("width > 0 and height > 0").distinct()
    o = media.oriented(F.col("width"), F.col("height"), F.col("orientation"))
    f = media.fit_within(F.col("w"), F.col("h"), 3840, 2160)
    return e.select("*", o["w"].alias("w"), o["h"].alias("h")).select("width", "height", "orientation", f["w"].alias("fit_w"), f["h"].alias("fit_h"))


def year_from_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("tag")).unionByName(table(spark, d, "audio").select(F.col("year").cast("string").alias("tag"))).distinct()
    return o.select("tag", media.year_tag(F.col("tag")).alias("year"))


def mp4_epoch(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select((F.col("o_orderkey") * 997 + 2082800000).alias("seconds"))
    return s.select("seconds", F.unix_micros(media.mp4_time(F.col("seconds"))).alias("at_us"))


def encoder_filter(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "video").select("encoder").distinct()
    return v.select("encoder", media.looks_like_encoder(F.col("encoder")).alias("is_encoder"))


def phash_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the hashes of matched files, computed anew."""
    r = table(spark, d, "file_records").select(ids.norm_id("id").alias("id"), ids.phash_bits("perceptual_hash").alias("bits")).where("bits is not null").groupBy("id").agg(F.max("bits").alias("bits"))
    m = table(spark, d, "perceptual_match").select(ids.norm_id("file_a_id").alias("a"), ids.norm_id("file_b_id").alias("b")).where("a is not null and b is not null").distinct()
    j = m.join(r.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(r.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    return j.select("a", "b", (1 - ids.hamming64(F.col("x"), F.col("y")) / F.lit(64.0)).alias("similarity"))


def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d)
    size = F.col("file_size")
    return a.select("source_path", paths.reject_reason(P(), size).alias("reason"), paths.cloud_stub(P(), size).alias("stub"), paths.skip_pattern(P(), Config().skip_filename_patterns).alias("pattern"))


def sniffed_types(spark: SparkSession, d: str) -> DataFrame:
    """Heads made of the kind of a path, so that each rule of detection is met."""
    heads = ["RIFFxxxxWEBP", "RIFFxxxxAVI ", "RIFFxxxxJUNK", "xxxxftypM4A ", "xxxxftypisom", "xxxxftypzzzz", "OggS", "%PDF-1.7", "GIF89a", "BM", ""]
    a = assets(spark, d).select("file_id", "source_path", F.element_at(F.array(*map(F.lit, heads)), (F.col("file_id") % 11 + 1).cast("int")).cast("binary").alias("head"))
    t = detect.content_type(P(), F.col("head"))
    return a.select("file_id", t["mime"].alias("mime"), t["file_type"].alias("file_type"))


def categorized(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d)
    return a.select("file_id", paths.file_type_of(P()).alias("file_type"), category_of().alias("category"))


def category_of():
    c = F.col
    has_date = c("date_original").isNotNull()
    image = categorize.image_category(P(), c("software"), c("make"), c("has_location"), c("width"), c("height"), has_date)
    video = categorize.video_category(P(), c("duration_seconds"), F.lit(False), c("make"), c("model"), c("has_location"))
    return categorize.category(paths.file_type_of(P()), image, video, categorize.audio_category(P(), c("has_tags")), categorize.document_category(P()))


def categorize_records(spark: SparkSession, d: str) -> DataFrame:
    """Images of the catalogue with their exif rows, by the image rules."""
    e = table(spark, d, "exif").groupBy(ids.norm_id("file_id").alias("file_id")).agg(F.min(F.struct("software", "make", "gps_lat", "gps_lon", "width", "height", "date_original", "date_digitized", "date_modified")).alias("e"))
    r = table(spark, d, "file_records").where("lower(trim(file_type)) = 'image'").groupBy(ids.norm_id("id").alias("file_id")).agg(F.min("source_path").alias("source_path"))
    x = lambda n: F.col(f"e.{n}")
    gps = x("gps_lat").isNotNull() | x("gps_lon").isNotNull()
    dated = x("date_original").isNotNull() | x("date_digitized").isNotNull() | x("date_modified").isNotNull()
    return r.join(e, "file_id").select("file_id", categorize.image_category(P(), x("software"), x("make"), gps, x("width"), x("height"), dated).alias("category"))


QUERIES = {f.__name__: f for f in (
    ext_split, ext_to_type, glob_match, sanitize_name, sha256_hash, normal_hashes, make_model, fmt_sizes, fmt_times, parse_name_date, exif_dates, gps_decimal,
    display_ratio, fit_size, year_from_text, mp4_epoch, encoder_filter, phash_similarity, skip_rules, sniffed_types, categorized, categorize_records)}

# --- SQL ---------------------------------------------------------------------------------------------------------

NAME = "regexp_extract({}, '([^/]*)$', 1)"
EXT = "regexp_extract(regexp_extract({}, '([^/]*)$', 1), '(?s)^\\.*[^.].*(\\.[^.]*)$', 1)"
ID = r"nullif(lower(regexp_replace({}, '^[\s\x00]+|[\s\x00]+$', '', 'g')), '')"
HASH = r"nullif(regexp_replace(lower(regexp_replace({}, '^[\s\x00]+|[\s\x00]+$', '', 'g')), '^(sha-?256[:=]\s*)?(0x)?', ''), '')"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def name(c: str) -> str:
    return NAME.format(c)


def ext(c: str) -> str:
    return EXT.format(c)


def stem(c: str) -> str:
    return f"left({name(c)}, length({name(c)}) - length({ext(c)}))"


def type_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({ext(c)}) IN {in_list(rules.dotted(v))} THEN '{k}'" for k, v in rules.TYPE_EXTENSIONS.items()) + " ELSE 'unknown' END"


def mime_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({ext(c)}) IN {in_list(rules.dotted(v))} THEN '{k}'" for k, v in rules.MIME.items()) + " ELSE 'application/octet-stream' END"


def globs_sql(c: str, patterns) -> str:
    return "(" + " OR ".join(f"coalesce({c} GLOB '{p}', false)" for p in patterns) + ")"


def sanitized(c: str) -> str:
    return f"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({c}, '[\\\\/:*?"<>|]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), '^\\.+|\\.+$', '', 'g'), ''), CASE WHEN {c} IS NOT NULL THEN 'unnamed' END)"""


def joined_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} WHEN starts_with(lower({b}), lower({a})) THEN {b} ELSE {a} || ' - ' || {b} END"


def label_sql(a: str, b: str) -> str:
    return sanitized(f"({joined_sql(f'trim({a})', f'trim({b})')})")


def ratio_sql(w: str, h: str) -> str:
    hits = " OR ".join(f"({w} % {x} = 0 AND {h} % {y} = 0 AND {w} // {x} = {h} // {y})" for a, b in rules.DISPLAY_RATIOS for x, y in ((a, b), (b, a)))
    return f"coalesce({w} > 0 AND {h} > 0 AND ({hits}), false)"


def screen_sql(w: str, h: str) -> str:
    hits = " OR ".join(f"(abs({w} - {x}) <= 10 AND abs({h} - {y}) <= 10)" for a, b in Config().screenshot_resolutions for x, y in ((a, b), (b, a)))
    return f"coalesce({hits}, false)"


def name_date_sql(c: str) -> str:
    """List of candidates by pattern: the first that is a date is taken."""
    import re

    out = []
    for p in Config().date_regex_patterns:
        at = {m: k for k, m in enumerate(re.findall(r"\(\?P<(\w)>", p), 1)}
        java = re.sub(r"\(\?P<\w>", "(", p)
        g = {m: f"TRY_CAST(regexp_extract({c}, '{java}', {at[m]}) AS INT)" if m in at else "0" for m in "YmdHMS"}
        sure = f"CASE WHEN {g['d']} <= 12 AND {g['m']} <= 12 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END" if list(at)[0] == "d" else "0.8::DOUBLE"
        stamp = f"TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', {', '.join(g[m] for m in 'YmdHMS')}) AS TIMESTAMP)"
        ok = f"{g['Y']} BETWEEN 1900 AND 2100 AND {g['m']} BETWEEN 1 AND 12 AND {g['d']} BETWEEN 1 AND 31 AND {g['H']} BETWEEN 0 AND 23 AND {g['M']} BETWEEN 0 AND 59 AND {g['S']} BETWEEN 0 AND 59"
        out.append(f"CASE WHEN {ok} AND {stamp} IS NOT NULL THEN {{'date': {stamp}, 'confidence': {sure}}} END")
    return f"coalesce({', '.join(out)})"


def image_sql(path: str, software: str, make: str, gps: str, w: str, h: str, dated: str) -> str:
    n, e, c = name(path), f"lower({ext(path)})", Config()
    return f"""CASE WHEN {e} IN {in_list(rules.dotted(rules.RAW))} THEN 'RAW'
  WHEN coalesce(regexp_matches({software}, '{"|".join(c.editor_patterns)}') AND NOT regexp_matches({software}, '{"|".join(c.editor_exclusions)}'), false) THEN 'Edited'
  WHEN {globs_sql(n, c.screenshot_filename_patterns)} THEN 'Screenshots' WHEN {globs_sql(n, c.social_media_image_patterns)} THEN 'Social Media'
  WHEN {make} IS NULL AND NOT coalesce({gps}, false) AND ({screen_sql(w, h)} OR {ratio_sql(w, h)}) THEN 'Screenshots'
  WHEN {e} IN {in_list(c.sidecar_extensions)} THEN 'Hidden' WHEN {make} IS NOT NULL THEN 'Originals' WHEN {dated} THEN 'Export' ELSE 'Collection' END"""


def category_sql(p: str = "source_path") -> str:
    n, e, c = name(p), f"lower({ext(p)})", Config()
    docs = " ".join(f"WHEN {e} IN {in_list(rules.dotted(v))} THEN 'Documents/{k}'" for k, v in rules.DOCUMENT_FOLDERS.items())
    return f"""CASE {type_sql(p)} WHEN 'image' THEN {image_sql(p, "software", "make", "has_location", "width", "height", "date_original IS NOT NULL")}
  WHEN 'video' THEN CASE WHEN duration_seconds < 10 AND {globs_sql(n, c.motion_photo_patterns)} THEN 'Motion Photos'
    WHEN {globs_sql(n, c.social_media_video_patterns)} THEN 'Social Media' WHEN make IS NOT NULL OR model IS NOT NULL THEN 'Camera'
    WHEN has_location OR {e} IN ('.3gp', '.3g2') THEN 'Mobile' WHEN {e} IN ('.mts', '.m2ts', '.mod', '.tod', '.mxf') THEN 'Camcorder'
    WHEN duration_seconds > 900 THEN 'Movies' ELSE 'Clips' END
  WHEN 'audio' THEN CASE WHEN {e} IN ('.m4a', '.aac', '.amr') AND {globs_sql(n, c.voice_note_patterns)} THEN 'Voice Notes'
    WHEN {e} IN ('.opus', '.ogg') AND {n} GLOB 'PTT-*-WA*' THEN 'WhatsApp' WHEN {globs_sql(n, c.call_recording_patterns)} THEN 'Call Recordings'
    WHEN has_tags OR {e} IN {in_list(rules.dotted(rules.MUSIC))} THEN 'Songs' ELSE 'Collection' END
  WHEN 'document' THEN CASE {docs} ELSE 'Documents/Others' END ELSE 'Other' END"""


REASON_SQL = f"""CASE WHEN len(list_filter(string_split(regexp_extract(source_path, '(?s)^(.*)/[^/]*$', 1), '/'), lambda x: x IN {in_list(rules.SKIP_DIRS)} OR starts_with(x, '.'))) > 0 THEN 'skip_dir'
  WHEN starts_with({name("source_path")}, '.') OR {name("source_path")} IN {in_list(rules.HIDDEN_NAMES)} THEN 'hidden_or_system'
  WHEN lower({ext("source_path")}) IN ('.tmp', '.temp') OR starts_with(lower({ext("source_path")}), '.thumb') THEN 'temp_or_cache'
  WHEN ({{stub}}) IS NOT NULL THEN 'cloud_stub:' || ({{stub}}) END"""
STUB_SQL = f"""CASE WHEN suffix(source_path, '.icloud') THEN 'icloud' WHEN suffix(source_path, '.cloud') OR suffix(source_path, '.odopen') THEN 'onedrive'
  WHEN suffix(source_path, '.dropbox') OR suffix(source_path, '.dropbox.attr') THEN 'dropbox'
  WHEN lower({ext("source_path")}) IN ('.gdoc', '.gsheet', '.gslides') AND file_size = 0 THEN 'gdrive' END"""
REASON_SQL = REASON_SQL.format(stub=STUB_SQL)

_EXIF_DATE = """CASE WHEN starts_with(t, '0000') THEN NULL ELSE coalesce(
  CASE WHEN regexp_full_match(t, '\\d{4}:\\d{1,2}:\\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}') THEN try_strptime(t, '%Y:%m:%d %H:%M:%S') END,
  CASE WHEN regexp_full_match(t, '\\d{4}:\\d{1,2}:\\d{1,2} \\d{1,2}:\\d{1,2}') THEN try_strptime(t, '%Y:%m:%d %H:%M') END,
  CASE WHEN regexp_full_match(t, '\\d{4}-\\d{1,2}-\\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}') THEN try_strptime(t, '%Y-%m-%d %H:%M:%S') END,
  CASE WHEN regexp_full_match(t, '\\d{4}-\\d{1,2}-\\d{1,2}T\\d{1,2}:\\d{1,2}:\\d{1,2}') THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S') END,
  CASE WHEN regexp_full_match(t, '\\d{4}:\\d{1,2}:\\d{1,2}') THEN try_strptime(t, '%Y:%m:%d') END) END"""

SQL = {
    "ext_split": f"SELECT DISTINCT source_path, {name('source_path')} AS name, {stem('source_path')} AS stem, {ext('source_path')} AS ext, regexp_extract(regexp_extract(source_path, '(?s)^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS folder FROM file_records",
    "ext_to_type": f"SELECT {type_sql('file_path')} AS file_type, {mime_sql('file_path')} AS mime, count(*) AS files FROM source_manifest GROUP BY 1, 2",
    "glob_match": f"WITH {ASSETS_SQL} SELECT source_path, {globs_sql(name('source_path'), Config().social_media_image_patterns)} AS social, {globs_sql(name('source_path'), Config().screenshot_filename_patterns)} AS shots, {globs_sql(name('source_path'), Config().call_recording_patterns)} AS calls FROM (SELECT source_path FROM file_records UNION SELECT source_path FROM assets)",
    "sanitize_name": f"SELECT DISTINCT title, {sanitized('title')} AS safe FROM audio WHERE title IS NOT NULL",
    "sha256_hash": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "normal_hashes": f"SELECT DISTINCT {ID.format('id')} AS file_id, {HASH.format('sha256_hash')} AS sha FROM file_records",
    "make_model": f"SELECT DISTINCT make, model, {label_sql('make', 'model')} AS label, {joined_sql(chr(110) + 'ullif(trim(make), ' + repr('') + ')', 'nullif(trim(model), ' + repr('') + ')')} AS camera FROM exif",
    "fmt_sizes": "SELECT DISTINCT file_size, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0::DOUBLE) WHEN file_size < 1073741824 THEN printf('%.1f MB', file_size / 1048576.0::DOUBLE) WHEN file_size < 1099511627776 THEN printf('%.1f GB', file_size / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', file_size / 1099511627776.0::DOUBLE) END AS shown FROM hashes WHERE file_size IS NOT NULL",
    "fmt_times": "SELECT DISTINCT duration_seconds, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm', s // 3600, s // 60 % 60) END AS shown FROM (SELECT duration_seconds, CAST(floor(duration_seconds) AS BIGINT) AS s FROM video WHERE duration_seconds IS NOT NULL)",
    "parse_name_date": f"WITH {ASSETS_SQL}, n AS (SELECT source_path, {stem('source_path')} AS s FROM (SELECT source_path FROM assets UNION SELECT source_path FROM file_records)), r AS (SELECT source_path, {name_date_sql('s')} AS r FROM n) SELECT source_path, r.date AS date, r.confidence AS confidence FROM r",
    "exif_dates": f"SELECT DISTINCT date_digitized, {_EXIF_DATE} AS date FROM (SELECT date_digitized, trim(date_digitized) AS t FROM exif WHERE date_digitized IS NOT NULL)",
    "gps_decimal": "SELECT k AS o_orderkey, round(CASE WHEN k % 2 = 0 THEN v ELSE -v END, 9) AS degrees FROM (SELECT o_orderkey AS k, (k % 180)::DOUBLE + (k % 600) / 10.0::DOUBLE / 60.0::DOUBLE + CASE WHEN k % 3 = 0 THEN 0 ELSE (k % 6000) / (k % 3 * 100)::DOUBLE / 3600.0::DOUBLE END AS v FROM orders)",
    "display_ratio": f"WITH {ASSETS_SQL} SELECT width, height, {ratio_sql('width', 'height')} AS ratio, {screen_sql('width', 'height')} AS screen FROM (SELECT width, height FROM exif UNION SELECT width, height FROM assets)",
    "fit_size": "WITH o AS (SELECT DISTINCT width, height, orientation, CASE WHEN orientation IN (5, 6, 7, 8) THEN height ELSE width END AS w, CASE WHEN orientation IN (5, 6, 7, 8) THEN width ELSE height END AS h FROM exif WHERE width > 0 AND height > 0), r AS (SELECT *, least(3840::DOUBLE / w, 2160::DOUBLE / h) AS r FROM o) SELECT width, height, orientation, CASE WHEN w <= 3840 AND h <= 2160 THEN w ELSE greatest(1, floor(w * r)::INT) END AS fit_w, CASE WHEN w <= 3840 AND h <= 2160 THEN h ELSE greatest(1, floor(h * r)::INT) END AS fit_h FROM r",
    "year_from_text": "WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS tag FROM orders UNION SELECT CAST(year AS VARCHAR) FROM audio) SELECT tag, CASE WHEN TRY_CAST(trim(split_part(tag, '-', 1)) AS INT) BETWEEN 1900 AND 2100 THEN TRY_CAST(trim(split_part(tag, '-', 1)) AS INT) END AS year FROM t",
    "mp4_epoch": "SELECT s AS seconds, CASE WHEN s > 2082844800 THEN (s - 2082844800) * 1000000 END AS at_us FROM (SELECT o_orderkey * 997 + 2082800000 AS s FROM orders)",
    "encoder_filter": f"SELECT DISTINCT encoder, coalesce(regexp_matches(lower(encoder), '{'|'.join(rules.ENCODER_WORDS)}'), false) AS is_encoder FROM video",
    "phash_similarity": f"""WITH r AS (SELECT {ID.format('id')} AS id, max(CASE WHEN regexp_full_match(p, '[0-9a-f]{{1,16}}') THEN ('0x' || p)::UBIGINT END::HUGEINT - CASE WHEN length(p) = 16 AND p >= '8' THEN 18446744073709551616::HUGEINT ELSE 0 END) AS bits
  FROM (SELECT id, regexp_replace(lower(trim(perceptual_hash)), '^(phash[:=]\\s*)?(0x)?', '') AS p FROM file_records) GROUP BY 1),
m AS (SELECT DISTINCT {ID.format('file_a_id')} AS a, {ID.format('file_b_id')} AS b FROM perceptual_match)
SELECT a, b, 1 - bit_count(xor(x.bits::BIGINT, y.bits::BIGINT)) / 64.0::DOUBLE AS similarity FROM m JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE x.bits IS NOT NULL AND y.bits IS NOT NULL""",
    "skip_rules": f"WITH {ASSETS_SQL} SELECT source_path, {REASON_SQL} AS reason, {STUB_SQL} AS stub, CASE WHEN {name('source_path')} GLOB '*.supplemental-metadata.json' THEN '*.supplemental-metadata.json' WHEN {name('source_path')} GLOB '{Config().skip_filename_patterns[1]}' THEN '{Config().skip_filename_patterns[1]}' END AS pattern FROM assets",
    "sniffed_types": f"""WITH {ASSETS_SQL} SELECT file_id,
  CASE file_id % 11 WHEN 0 THEN 'image/webp' WHEN 1 THEN 'video/x-msvideo' WHEN 3 THEN 'audio/mp4' WHEN 4 THEN CASE WHEN {type_sql('source_path')} = 'audio' THEN {mime_sql('source_path')} ELSE 'video/mp4' END WHEN 5 THEN CASE WHEN {type_sql('source_path')} = 'audio' THEN {mime_sql('source_path')} ELSE 'video/mp4' END
    WHEN 6 THEN 'audio/ogg' WHEN 7 THEN 'application/pdf' WHEN 8 THEN 'image/gif' WHEN 9 THEN 'image/bmp' ELSE {mime_sql('source_path')} END AS mime,
  CASE file_id % 11 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN CASE WHEN {type_sql('source_path')} = 'audio' THEN 'audio' ELSE 'video' END WHEN 5 THEN CASE WHEN {type_sql('source_path')} = 'audio' THEN 'audio' ELSE 'video' END
    WHEN 6 THEN 'audio' WHEN 7 THEN 'document' WHEN 8 THEN 'image' WHEN 9 THEN 'image' ELSE {type_sql('source_path')} END AS file_type FROM assets""",
    "categorized": f"WITH {ASSETS_SQL} SELECT file_id, {type_sql('source_path')} AS file_type, {category_sql()} AS category FROM assets",
    "categorize_records": f"""WITH e AS (SELECT {ID.format('file_id')} AS file_id, min(row(software, make, gps_lat, gps_lon, width, height, date_original, date_digitized, date_modified)) AS e FROM exif GROUP BY 1),
x AS (SELECT file_id, e[1] AS software, e[2] AS make, e[3] AS lat, e[4] AS lon, e[5] AS w, e[6] AS h, coalesce(e[7], e[8], e[9]) IS NOT NULL AS dated FROM e),
r AS (SELECT {ID.format('id')} AS file_id, min(source_path) AS source_path FROM file_records WHERE lower(trim(file_type)) = 'image' GROUP BY 1)
SELECT file_id, {image_sql('source_path', 'software', 'make', '(lat IS NOT NULL OR lon IS NOT NULL)', 'w', 'h', 'dated')} AS category FROM r JOIN x USING (file_id)""",
}
