"""Tables of the catalogue as Parquet: appended to, never updated in place; the latest version of a row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "source_manifest": _schema(id=_L, session_id=_S, source_dir=_S, file_path=_S, file_size=_L, mtime=_D),
    "hashes": _schema(sha256_hash=_S, rel_path=_S, file_size=_L, added_at=_TS),
    "duplicate_groups": _schema(id=_S, session_id=_S, winner_file_id=_S, hash_value=_S, match_type=_S, file_count=_L, bytes_saved=_L),
}


def append(df: DataFrame, root: str, table: str, by: list[str] | None = None) -> None:
    """Adds rows to a table, by partition columns if given."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(f"{root}/{table}.parquet")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table; an empty one of its schema if it was never written."""
    path = f"{root}/{table}.parquet"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.parquet(path)


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest version; rows with a null key are left out."""
    rest = [c for c in df.columns if c not in keys]
    some = df.where(" and ".join(f"{k} is not null" for k in keys))
    return some.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def pending(records: DataFrame) -> DataFrame:
    """Records that a run still has to do."""
    return records.where("lower(trim(status)) in ('pending', 'processing')")


def by_hash(records: DataFrame, sha: str) -> DataFrame:
    """The record of a hash: the smallest id if there are several."""
    return records.where(F.col("sha256_hash") == sha).orderBy("id").limit(1)


def archived(sessions: DataFrame, session_id: str) -> DataFrame:
    """sessions with one marked as archived."""
    return sessions.withColumn("is_archived", F.when(F.col("id") == session_id, F.lit(True)).otherwise(F.col("is_archived")))


def compact(spark: SparkSession, root: str, table: str, keys: list[str], version: list[str], to: str) -> None:
    """Writes the latest rows of a table anew under another root."""
    latest(read(spark, root, table), keys, version).write.mode("overwrite").parquet(f"{to}/{table}.parquet")
