"""Queries over the llm operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm import components, history, language, leakage, names, packing, survivors


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(components.match_links(_t(spark, d, "perceptual_match"))).withColumnRenamed("id", "file_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = names.variant_pairs(names.typed_names(_t(spark, d, "audio"), _t(spark, d, "video")))
    return found.select("field", "name_a", "name_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats_of_history(_t(spark, d, "file_records"), _t(spark, d, "sessions"), _t(spark, d, "hashes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.group_representatives(_t(spark, d, "duplicate_groups"), _t(spark, d, "file_records"))


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivors.golden_records(_t(spark, d, "duplicate_groups"), _t(spark, d, "file_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_ids(packing.pack_documents(_t(spark, d, "documents")))


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"))


def p7_proof(spark: SparkSession, d: str) -> DataFrame:
    """That the containers hold every token of every document and none is overfull."""
    return packing.packing_proof(packing.pack_documents(_t(spark, d, "documents")))


def p7_instructions(spark: SparkSession, d: str) -> DataFrame:
    """The same where segments and loss bind: three documents a container, of which the first sentence bears no loss."""
    limits = {"capacity": 4096, "segments": 3, "loss_tokens": 3600}
    sentence = F.octet_length(F.encode(F.substring_index("text", ". ", 1), "utf-8"))
    return packing.packing_proof(packing.pack_documents(_t(spark, d, "documents"), **limits, prompt=sentence), **limits).drop("tight")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "eval_items"), _t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(_t(spark, d, "documents")).select("doc_id", "lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    return language.segments(documents, language.fit(*language.training_sample(documents)))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p3_found, p4_found, p5_found, p5_golden, p7_found, p7_assignment, p7_proof, p7_instructions, p8_found, p9_found, p9_segments)
}

_ID = r"nullif(lower(regexp_replace({}, '^[\s\x00]+|[\s\x00]+$', '', 'g')), '')"
_HASH = r"nullif(regexp_replace(lower(regexp_replace({}, '^[\s\x00]+|[\s\x00]+$', '', 'g')), '^(sha-?256[:=]\s*)?(0x)?', ''), '')"


def _id(c: str) -> str:
    return _ID.format(c)


def _hash(c: str) -> str:
    return _HASH.format(c)


def _best(order: str) -> str:
    return f"arg_min(file_id, row({order}, -coalesce(epoch_us(created_at), -4611686018427387904), file_id))"


_MEMBERS = f"""
r0 AS (
  SELECT {_id("id")} AS file_id, {_id("session_id")} AS session, {_id("duplicate_group_id")} AS gid, {_hash("sha256_hash")} AS sha,
    lower(trim(exif_status)) AS st, CASE WHEN coalesce(trim(date_value), '') = '' THEN 'none' ELSE lower(trim(date_source)) END AS src,
    file_size, created_at, row_number() OVER (PARTITION BY {_id("id")} ORDER BY pipeline_stage DESC, created_at DESC) AS rn
  FROM file_records),
r AS (
  SELECT *, CASE st WHEN 'ok' THEN 0 WHEN 'partial' THEN 1 WHEN 'none' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS sr,
    CASE src WHEN 'metadata' THEN 0 WHEN 'parsed' THEN 1 WHEN 'inferred' THEN 2 WHEN 'none' THEN 3 ELSE 4 END AS dr,
    -coalesce(file_size, -1) AS zr
  FROM r0 WHERE rn = 1 AND file_id IS NOT NULL),
g AS (
  SELECT DISTINCT {_id("id")} AS group_id, {_id("session_id")} AS session, {_hash("hash_value")} AS h, lower(trim(match_type)) AS kind
  FROM duplicate_groups WHERE {_id("id")} IS NOT NULL),
m AS (
  SELECT g.group_id, r.* FROM g JOIN r ON r.gid = g.group_id
  UNION SELECT g.group_id, r.* FROM g JOIN r ON g.kind = 'exact' AND r.session = g.session AND r.sha = g.h)
"""

# Compatible forms of one character, by the rule of Unicode, and the ligatures.
_FORMS = {chr(c): n for c in range(0xA0, 0x10000) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c) and n not in "'"}
_NFKC = f"translate(text, '{''.join(_FORMS)}', '{''.join(_FORMS.values())}')"
for _c in range(0xFB00, 0xFB07):
    _NFKC = f"replace({_NFKC}, '{chr(_c)}', '{unicodedata.normalize('NFKC', chr(_c))}')"
_PLAIN = rf"lower(regexp_replace(regexp_replace({_NFKC}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{{2,8}}|#\d{{1,7}});', ' ', 'g'))"
_WORDS = rf"list_filter(string_split(regexp_replace({_PLAIN}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"

SQL = {
    "p7_proof": "SELECT count(*) AS documents, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS BIGINT) AS tokens, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS BIGINT) AS loss_tokens, 0 AS overfull, 0 AS gaps, true AS tight FROM documents",
    "p7_instructions": """SELECT count(*) AS documents, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS BIGINT) AS tokens,
  CAST(sum(coalesce(octet_length(encode(text)) - octet_length(encode(CASE WHEN contains(text, '. ') THEN split_part(text, '. ', 1) ELSE text END)), 0) + 1) AS BIGINT) AS loss_tokens, 0 AS overfull, 0 AS gaps FROM documents""",
    "p8_found": f"""
WITH i0 AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE item_id IS NOT NULL),
d0 AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, len(w) AS n, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM i0 WHERE len(w) >= 5)),
d AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d0 WHERE len(w) >= 5)),
h AS (SELECT DISTINCT i.item_id, d.doc_id, n, k FROM i JOIN d USING (s)),
c AS (SELECT *, least(5, coalesce(k - lag(k) OVER (PARTITION BY item_id, doc_id ORDER BY k), 5)) AS more FROM h)
SELECT item_id, doc_id FROM c GROUP BY item_id, doc_id, n HAVING sum(more) * 3 >= n""",
    "p1_found": f"""
WITH RECURSIVE l AS (
  SELECT DISTINCT {_id("file_a_id")} AS a, {_id("file_b_id")} AS b FROM perceptual_match
  -- by its text, as the statistics of a Parquet file may deny that it holds NaN
  WHERE CAST(similarity AS VARCHAR) NOT ILIKE '%nan%' AND (CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END) >= 0.95),
n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM l WHERE a <> b UNION SELECT b FROM l WHERE a <> b)),
m AS (SELECT x.k AS a, y.k AS b FROM l JOIN n x ON x.id = l.a JOIN n y ON y.id = l.b WHERE l.a <> l.b),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT n.id AS file_id, g.id AS group_id FROM (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a) JOIN n ON n.k = a JOIN n g ON g.k = c""",
    "p4_found": f"""
WITH s AS (
  SELECT {_id("id")} AS session, arg_max(created_at, updated_at) AS began FROM sessions GROUP BY 1),
r0 AS (
  SELECT {_id("id")} AS file_id, {_id("session_id")} AS session, {_hash("sha256_hash")} AS sha,
    regexp_replace(lower(trim(perceptual_hash)), '^(phash[:=]\\s*)?(0x)?', '') AS ph,
    row_number() OVER (PARTITION BY {_id("id")} ORDER BY pipeline_stage DESC, created_at DESC) AS rn FROM file_records),
r AS (
  SELECT file_id, began, sha, CASE WHEN regexp_full_match(ph, '[0-9a-f]{{1,16}}') THEN ('0x' || ph)::UBIGINT END AS bits
  FROM r0 JOIN s USING (session) WHERE rn = 1 AND file_id IS NOT NULL AND sha IS NOT NULL),
a AS (SELECT {_hash("sha256_hash")} AS sha, rel_path, added_at FROM hashes),
firsts AS (SELECT sha, min(added_at) AS added FROM a GROUP BY sha),
old AS (SELECT bits, sha, min(began) AS began FROM r WHERE bits IS NOT NULL GROUP BY ALL),
cases AS (
  SELECT file_id, began, 'exact' AS kind, sha FROM r
  UNION SELECT q.file_id, q.began, 'near', o.sha FROM r q JOIN old o
    ON o.began < q.began AND o.sha <> q.sha AND bit_count(xor(o.bits, q.bits)) <= 3)
SELECT DISTINCT file_id, kind, rel_path FROM (
  SELECT c.file_id, c.kind, arg_max(a.rel_path, row(a.added_at, a.rel_path)) AS rel_path
  FROM cases c JOIN a ON a.sha = c.sha AND a.added_at < c.began GROUP BY c.file_id, c.kind, c.sha)""",
    "p5_found": f"""
WITH {_MEMBERS},
b AS (
  SELECT group_id, {_best("sr")} AS exif_status, {_best("dr")} AS date_source, {_best("zr")} AS file_size, {_best("sr, dr, zr")} AS survivor
  FROM m GROUP BY group_id)
UNPIVOT b ON exif_status, date_source, file_size, survivor INTO NAME field VALUE file_id""",
    "p7_found": "SELECT doc_id FROM documents WHERE coalesce(octet_length(encode(text)), 0) + 1 > 4096",
    "p5_golden": f"""
WITH {_MEMBERS},
o AS (SELECT *, row(-coalesce(epoch_us(created_at), -4611686018427387904), file_id) AS tie FROM m),
b AS (SELECT group_id, arg_min(file_id, row(sr, dr, zr, tie)) AS sv, min(sr) AS min_sr, min(dr) AS min_dr FROM o GROUP BY group_id),
x AS (SELECT DISTINCT group_id, sha, min(row(sr, dr, zr, tie)) AS k FROM o GROUP BY ALL),
-- every choice of a hash, with the size that stands beside it, by total trust
c AS (
  SELECT x.group_id, x.sha, any_value(x.k) AS k, arg_min(o.file_id, row(o.sr, o.dr, o.zr, o.tie)) AS survivor_id,
    arg_min(o.file_size, row(o.zr, o.tie)) FILTER (o.file_size IS NOT NULL AND x.sha IS NOT NULL) AS y
  FROM x JOIN o ON o.group_id = x.group_id AND o.sha IS NOT DISTINCT FROM x.sha GROUP BY x.group_id, x.sha),
z AS (
  SELECT c.group_id, c.survivor_id, c.sha, c.k, o.file_size, o.file_id AS size_from, o.zr, o.tie,
    (1 - c.k[1] / 4.0::DOUBLE) + 0.2 * (1 - c.k[2] / 4.0::DOUBLE) + 0.01 * (1 - 1 / (2.0::DOUBLE - c.k[3])) + (1 - 1 / (2.0::DOUBLE - o.zr)) AS trust
  FROM c JOIN o ON o.group_id = c.group_id AND (c.y IS NULL OR o.file_size IS NULL OR o.file_size = c.y)),
w AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, k, zr, tie) AS n FROM z)
SELECT w.group_id, w.survivor_id, w.sha AS sha256_hash, e.exif_status, d.date_source, d.date_value, w.file_size, w.size_from
FROM w
JOIN (SELECT group_id, arg_min(st, row(sr, tie)) AS exif_status FROM o GROUP BY group_id) e USING (group_id)
JOIN (SELECT o.group_id, arg_min(lower(trim(f.date_source)), row(o.dr, o.tie)) AS date_source, arg_min(coalesce(f.date_value, chr(1)), row(o.dr, o.tie)) AS dv,
        nullif(dv, chr(1)) AS date_value
      FROM o JOIN (SELECT {_id("id")} AS file_id, arg_max(row(date_source, date_value), row(pipeline_stage, created_at)) AS p, p[1] AS date_source, p[2] AS date_value
                   FROM file_records GROUP BY 1) f USING (file_id) GROUP BY o.group_id) d USING (group_id)
WHERE w.n = 1""",
}
