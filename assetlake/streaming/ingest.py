"""Streaming ingest: new records against the manifest of accepted hashes, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlake.functions.ids import norm_hash
from assetlake.functions.records import current_records
from assetlake.sources import store


def ingest_batch(batch: DataFrame, epoch: int, root: str) -> None:
    """Marks the duplicates of a batch (of the manifest or of a better row of the batch), appends its decisions and
    the hashes that it accepts. Writes go to folders of the epoch and replace what an earlier try left, so that a
    batch that is run again counts once."""
    spark = batch.sparkSession
    rows = current_records(batch, "source_path", "sha256_hash", "file_size", "created_at").withColumn("sha256_hash", norm_hash("sha256_hash"))
    known = accepted(spark, root, epoch).select("sha256_hash").distinct().withColumn("_known", F.lit(True))
    best = rows.where("sha256_hash is not null").groupBy("sha256_hash").agg(F.min(F.struct("created_at", "file_id")).alias("_b"))
    j = rows.join(known, "sha256_hash", "left").join(best, "sha256_hash", "left")
    dup = F.col("_known").isNotNull() | (F.col("_b").isNotNull() & (F.col("_b.file_id") != F.col("file_id")))
    out = j.withColumn("is_duplicate", F.coalesce(dup, F.lit(False))).drop("_known", "_b")
    out.write.mode("overwrite").parquet(f"{root}/decisions/epoch={epoch}")
    new = spark.read.parquet(f"{root}/decisions/epoch={epoch}").where("not is_duplicate and sha256_hash is not null")
    new.select("sha256_hash", F.col("source_path").alias("rel_path"), "file_size", F.col("created_at").alias("added_at")).write.mode("overwrite").parquet(f"{root}/manifest/epoch={epoch}")


def accepted(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The manifest that batches before an epoch have written, or all."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], store.SCHEMAS["hashes"])
    m = spark.read.parquet(f"{root}/manifest")
    return (m.where(F.col("epoch") < before) if before is not None else m).drop("epoch")


def start_ingest(spark: SparkSession, source: str, schema, root: str, files_per_batch: int = 1) -> StreamingQuery:
    """A stream of Parquet files of records into `root`; ends when it has read all that is there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, epoch: ingest_batch(df, epoch, root))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """file_id, is_duplicate of all batches, the first decision of a file counting."""
    d = spark.read.parquet(f"{root}/decisions")
    w = Window.partitionBy("file_id").orderBy("epoch")
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").select("file_id", "sha256_hash", "is_duplicate")


def progress_counts(df: DataFrame, name: str = "ingest") -> DataFrame:
    """df observed: files, bytes and duplicates are reported to listeners as rows pass, at no further action."""
    return df.observe(name, F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.count_if(F.col("is_duplicate")).alias("duplicates"))


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window of a stream or table, late ones up to the watermark."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    marked = e.withWatermark("at", late) if e.isStreaming else e
    w = marked.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
