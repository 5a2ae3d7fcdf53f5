"""The current rows of the tables as delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.ids import norm_id

#: Fixed orders, best first.
EXIF_STATUS = ("ok", "partial", "none", "error")
DATE_SOURCE = ("metadata", "parsed", "inferred", "none")


def current_records(file_records: DataFrame, *fields: str) -> DataFrame:
    """file_id and `fields` of the current row of each id: the one with the greatest pipeline_stage, the latest
    created_at among equals. Rows without id are ignored."""
    kept = file_records.select(norm_id("id").alias("file_id"), F.struct(F.coalesce("pipeline_stage", F.lit(-1)).alias("n"), "created_at").alias("v"), F.struct(*fields).alias("r"))
    return kept.where("file_id is not null").groupBy("file_id").agg(F.max_by("r", "v").alias("r")).select("file_id", "r.*")


def current_sessions(sessions: DataFrame) -> DataFrame:
    """session_key, session_id, created_at, state of the current row of each session id (greatest updated_at)."""
    best = sessions.where(norm_id("id").isNotNull()).groupBy(norm_id("id").alias("session_key")).agg(F.max_by(F.struct("id", "created_at", "state"), F.struct("updated_at", "created_at")).alias("s"))
    return best.select("session_key", F.col("s.id").alias("session_id"), "s.created_at", F.lower(F.trim("s.state")).alias("state"))


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a text in an order, best 0, in any case; unknown and null texts come last."""
    v = F.lower(F.trim(value))
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(v == name, F.lit(k)).otherwise(out)
    return out
