"""The asset projection: documents as files of a catalogue, with metadata, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Names by n % 20, n being doc_id div 7, which is dense, as (text before, number, its padding, text after).
_NAMES = {
    0: ("IMG_", "n", 6, ".jpg"), 1: ("IMG-20240315-WA", "n % 10000", 4, ".jpg"), 2: ("Screenshot_2024-03-15-10-20-30_", "n", 0, ".png"),
    3: ("IMG_20240315_143000_BURST", "n % 1000", 3, ".jpg"), 4: ("DSC_", "b", 0, ".CR2"), 5: ("dsc_", "b", 0, ".jpg"), 6: ("VID-20240101-WA", "n", 0, ".mp4"),
    7: ("MOTION_", "n", 0, ".mp4"), 8: ("clip_", "n", 0, ".mov"), 9: ("rec_", "n", 0, ".3gp"), 10: ("tape_", "n", 0, ".mts"),
    11: ("Voice_", "n", 0, ".m4a"), 12: ("PTT-20240101-WA", "n", 0, ".opus"), 13: ("song_", "n", 0, ".mp3"), 14: ("report_2024-02-30_", "n", 0, ".pdf"),
    15: ("notes 05-03-2024 ", "n", 0, ".txt"), 16: (".hidden_", "n", 0, ".jpg"), 17: ("cache_", "n", 0, ".thumb1"), 18: ("clip_", "(n - 10)", 0, ".srt"), 19: ("data_", "n", 0, ".xyz"),
}


def _name_sql(text: str) -> str:
    cases = []
    for k, (a, n, pad, z) in _NAMES.items():
        num = f"cast({n} as {text})"
        cases.append(f"when k = {k} then concat('{a}', {f'lpad({num}, {pad}, {chr(39)}0{chr(39)})' if pad else num}, '{z}')")
    return "case " + " ".join(cases) + " end"


_META = {
    "width": "case n % 7 when 0 then 1080 when 1 then 1600 when 2 then 4032 when 3 then 1000 when 4 then 2048 when 5 then 37 end",
    "height": "case n % 7 when 0 then 1920 when 1 then 900 when 2 then 3024 when 3 then 777 when 4 then 2732 when 5 then 53 end",
    "make": "case n % 5 when 0 then 'Canon' when 1 then 'SONY' when 2 then 'Apple' end",
    "model": "case n % 5 when 0 then 'Canon EOS R5' when 1 then 'ILCE-7M4' when 3 then 'Pixel 8' end",
    "software": "case n % 11 when 0 then 'Adobe Photoshop 24.0' when 1 then 'Picasa 3.9' when 2 then 'GIMP 2.10' when 3 then 'Firmware 1.0' end",
    "has_tags": "n % 3 = 0",
    "has_location": "n % 6 = 0",
}


def assets(spark: SparkSession, d: str) -> DataFrame:
    """file_id, arrival, session_id, source_dir, source_path, file_size, sha256_hash, mtime, and metadata columns."""
    t = table(spark, d, "documents").selectExpr("doc_id", "text", "coalesce(nullif(trim(lang), ''), 'und') as lang", "doc_id div 7 as n", "doc_id div 7 % 20 as k", "doc_id div 140 as b")
    t = t.selectExpr("*", "concat('/src/root', b % 5) as source_dir", f"{_name_sql('string')} as name")
    return t.selectExpr(
        "doc_id as file_id", "doc_id as arrival", "concat('sess-', n % 3) as session_id", "source_dir", "concat(source_dir, '/', lang, '/', name) as source_path",
        "cast(octet_length(text) as bigint) as file_size", "sha2(text, 256) as sha256_hash", "cast(1700000000 + (n * 7919) % 100000 as double) as mtime",
        *(f"{v} as {k}" for k, v in _META.items()), "cast((n * 37) % 2000 as double) as duration_seconds",
        "case when n % 4 = 0 then timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(n as int), 0, 0) end as date_original",
    )


ASSETS_SQL = f"""
t0 AS (SELECT doc_id, text, coalesce(nullif(trim(lang), ''), 'und') AS lang, doc_id // 7 AS n, doc_id // 7 % 20 AS k, doc_id // 140 AS b FROM documents),
t1 AS (SELECT *, concat('/src/root', b % 5) AS source_dir, {_name_sql("varchar")} AS name FROM t0),
assets AS (
  SELECT doc_id AS file_id, doc_id AS arrival, concat('sess-', n % 3) AS session_id, source_dir, concat(source_dir, '/', lang, '/', name) AS source_path,
    CAST(strlen(text) AS BIGINT) AS file_size, sha256(text) AS sha256_hash, CAST(1700000000 + (n * 7919) % 100000 AS DOUBLE) AS mtime,
    {", ".join(f"{v} AS {k}" for k, v in _META.items())}, CAST((n * 37) % 2000 AS DOUBLE) AS duration_seconds,
    CASE WHEN n % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n AS INT)) END AS date_original
  FROM t1)"""


def asset_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return assets(spark, d).drop("arrival")


QUERIES = {"asset_catalogue": asset_catalogue}
SQL = {"asset_catalogue": f"WITH {ASSETS_SQL} SELECT * EXCLUDE (arrival) FROM assets"}
