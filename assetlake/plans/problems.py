"""Queries p2 and p6 of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlake.operators.instants import recorded_instants
from assetlake.operators.snapshot_diff import manifest_changes


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return manifest_changes(_t(spark, d, "source_manifest"), _t(spark, d, "sessions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return recorded_instants(_t(spark, d, "file_records"), _t(spark, d, "exif"))


QUERIES = {"p2_found": p2_found, "p6_found": p6_found}

_ID = r"nullif(lower(regexp_replace({}, '^[\s\x00]+|[\s\x00]+$', '', 'g')), '')"

_DAY = 86_400_000_000
_ZONED = r"z|utc|gmt|(?:utc|gmt)?[+\-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+\-]+)+"
_WALL = rf"^(\d{{4}})-(\d{{1,2}}|[a-z]{{3}})-(\d{{1,2}})[t ](\d{{1,2}}):(\d{{2}})(?::(\d{{2}})?(?:[.,](\d{{1,9}}))?)?(?: ?([ap])\.?m\.?)?(?: ?\[?({_ZONED})\]?)?$"
_OFFSET = r"^(?:utc|gmt)?\s*([+\-−])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?$"


def _year_first(c: str) -> str:
    for shape, ordered in (
        (r"^(\d{4})[:/](\d{1,2})[:/](\d{1,2})[t ]", r"\1-\2-\3 "), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[t ]", r"\3-\2-\1 "), (r"^(\d{1,2})/(\d{1,2})/(\d{4})[t ]", r"\3-\1-\2 "),
        (r"^(?:[a-z]{3,9},? )?(\d{1,2})[ \-]([a-z]{3})[a-z]*\.?[ \-](\d{4}),? ", r"\3-\2-\1 "), (r"^(\d{4})(\d{2})(\d{2})[t ](\d{2})(\d{2})(\d{2})?", r"\1-\2-\3 \4:\5:\6"),
    ):
        c = f"regexp_replace({c}, '{shape}', '{ordered}')"
    return c


def _at(wall: str, zone: str) -> str:
    """What DuckDB takes a wall time (in microseconds) of a zone for, in microseconds of UTC."""
    return f"epoch_us(make_timestamp({wall}) AT TIME ZONE {zone})"


SQL = {
    # The offsets a day before and a day after a wall time are those that it may have: of the two instants the earlier one
    # that shows the wall time, and in a gap the one by the offset before.
    "p6_found": f"""
WITH r AS (
  SELECT {_ID.format("id")} AS file_id, arg_max(row(date_value, date_source, timezone_offset), pipeline_stage) AS r FROM file_records GROUP BY 1),
v AS (
  SELECT file_id, 'record' AS origin, r[1] AS t, r[3] AS z FROM r WHERE file_id IS NOT NULL AND coalesce(lower(trim(r[2])), 'none') <> 'none'
  UNION SELECT {_ID.format("file_id")}, 'exif', date_original, timezone_offset FROM exif WHERE {_ID.format("file_id")} IS NOT NULL),
t AS (SELECT file_id, origin, {_year_first("lower(trim(regexp_replace(t, '[\\s\\x00]+', ' ', 'g')))")} AS t, lower(trim(z)) AS z FROM v WHERE t IS NOT NULL),
g AS (SELECT *, regexp_extract(t, '{_WALL}', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'ap', 'z']) AS m FROM t),
n AS (
  SELECT file_id, origin, t, coalesce(nullif(m.z, ''), z) AS z, TRY_CAST(m.y AS INT) AS y, TRY_CAST(m.d AS INT) AS d, TRY_CAST(m.mi AS INT) AS mi,
    coalesce(TRY_CAST(m.mo AS INT), nullif(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], m.mo), 0)) AS mo,
    CASE WHEN m.ap = '' THEN TRY_CAST(m.h AS INT) WHEN TRY_CAST(m.h AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(m.h AS INT) % 12 + CASE WHEN m.ap = 'p' THEN 12 ELSE 0 END END AS h,
    coalesce(TRY_CAST(m.s AS INT), 0) AS s, coalesce(TRY_CAST(left(rpad(m.f, 6, '0'), 6) AS BIGINT), 0) AS us
  FROM g),
w AS (
  SELECT *, CASE WHEN regexp_full_match(t, '-?\\d{{1,10}}') AND NOT regexp_full_match(t, '\\d{{8}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '-?\\d{{11,13}}') THEN CAST(t AS BIGINT) * 1000 END AS number,
    CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59
      THEN epoch_us(TRY_CAST(printf('%04d-%02d-%02d', y, mo, d) AS TIMESTAMP)) + (h * 3600 + mi * 60 + s) * 1000000::BIGINT + us END AS wall,
    CASE WHEN z IN ('z', 'utc', 'gmt') THEN 0 WHEN regexp_matches(z, '{_OFFSET}') THEN
      (coalesce(TRY_CAST(regexp_extract(z, '{_OFFSET}', 2) AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(z, '{_OFFSET}', 3) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(z, '{_OFFSET}', 4) AS BIGINT), 0))
      * CASE WHEN regexp_extract(z, '{_OFFSET}', 1) = '+' THEN 1 ELSE -1 END END AS off
  FROM n),
i AS (SELECT w.*, k.name AS zone FROM w LEFT JOIN (SELECT DISTINCT lower(name) AS k, name FROM pg_timezone_names()) k ON w.off IS NULL AND w.number IS NULL AND w.z = k.k AND w.wall IS NOT NULL),
c AS (
  SELECT *, CASE WHEN zone IS NOT NULL THEN wall + {_at(f"wall - {_DAY}", "zone")} - (wall - {_DAY}) END AS a,
    CASE WHEN zone IS NOT NULL THEN wall + {_at(f"wall + {_DAY}", "zone")} - (wall + {_DAY}) END AS b FROM i),
x AS (
  SELECT *, epoch_us(make_timestamptz(a) AT TIME ZONE zone) = wall AS a_shows, epoch_us(make_timestamptz(b) AT TIME ZONE zone) = wall AS b_shows FROM c)
SELECT DISTINCT file_id, origin, CAST(coalesce(number, wall - off * 1000000,
  CASE WHEN a_shows AND b_shows THEN least(a, b) WHEN a_shows THEN a WHEN b_shows THEN b ELSE a END) AS BIGINT) AS utc_us
FROM x WHERE coalesce(number, wall - off * 1000000, a) IS NOT NULL""",
    "p2_found": f"""
WITH s AS (
  SELECT {_ID.format("id")} AS k, arg_max(id, updated_at) AS session_id, arg_max(lower(trim(state)), updated_at) AS state,
    arg_max(created_at, updated_at) AS created_at, arg_max(source_dirs, updated_at) AS dirs, arg_max(destination_dir, updated_at) AS dest
  FROM sessions GROUP BY 1),
snap AS (
  SELECT k, session_id, dest, dir, row_number() OVER (PARTITION BY dest, dir ORDER BY created_at) AS seq
  FROM (SELECT DISTINCT k, session_id, created_at, dest, unnest(dirs) AS dir FROM s WHERE state = 'completed')),
m AS (
  SELECT {_ID.format("session_id")} AS k, file_path, arg_max(row(source_dir, file_size, mtime), id) AS v FROM source_manifest
  WHERE file_path IS NOT NULL GROUP BY ALL),
f AS (SELECT snap.dest, snap.dir, snap.seq, m.file_path, m.v[2] AS sz, m.v[3] AS mt FROM m JOIN snap ON snap.k = m.k AND snap.dir = m.v[1]),
c AS (
  SELECT b.session_id, x.file_path, x.sz, x.mt, x.dest, x.dir, b.seq FROM snap b JOIN f x ON x.dest IS NOT DISTINCT FROM b.dest AND x.dir = b.dir AND x.seq = b.seq WHERE b.seq > 1),
p AS (
  SELECT b.session_id, x.file_path, x.sz, x.mt, b.dest, b.dir, b.seq FROM snap b JOIN f x ON x.dest IS NOT DISTINCT FROM b.dest AND x.dir = b.dir AND x.seq = b.seq - 1)
SELECT coalesce(c.session_id, p.session_id) AS session_id, coalesce(c.file_path, p.file_path) AS file_path,
  CASE WHEN p.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM c FULL JOIN p ON c.session_id = p.session_id AND c.dest IS NOT DISTINCT FROM p.dest AND c.dir = p.dir AND c.file_path = p.file_path
WHERE c.file_path IS NULL OR p.file_path IS NULL OR c.sz IS DISTINCT FROM p.sz OR c.mt IS DISTINCT FROM p.mt""",
}
