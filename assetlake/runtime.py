"""What the operators need from the cluster: cut lineage, checked broadcasts, lookups that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()

#: A side of at most so many rows and bytes may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application, so that their Python can import it from anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="assetlake-"), "assetlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local master gets a temporary folder of its own; on a cluster an unset folder is an error,
    because a machine-local one would vanish with its executor.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="assetlake-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/assetlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "step", **seen: Column) -> DataFrame:
    """Writes df as a table in the shared folder and returns a scan of it: lineage ends here, and a lost
    executor costs nothing of what was written. seen: aggregates that are taken as rows are written, at no job of their
    own; seen_of() tells them."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    told = Observation()
    watched = df.observe(told, *(c.alias(k) for k, c in seen.items())) if seen else df
    watched.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._assetlake_path = path
    out._assetlake_seen = told.get if seen else {}
    return out


def seen_of(df: DataFrame, name: str):
    """An aggregate that cut() took of df."""
    return df._assetlake_seen[name]


def discard(df: DataFrame | None) -> None:
    """Deletes a table written by cut() that no later plan reads."""
    path = getattr(df, "_assetlake_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            return


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows of at most `size` bytes in all (as JSON text), else df as
    it is, for a shuffled join.

    df must be cheap to read: a table written by cut() or a small source. Not more than rows + 1 rows are measured.
    """
    text = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    n, b = df.limit(rows + 1).select(text.alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


#: Bits of a sieve, in chunks of 32,768 bits: 16 MB at most.
SIEVE_BITS = 1 << 27


def sieved(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be among `keys` (a DataFrame with the column `key`): all that are, and of the others as
    many as there are bits set in a table of SIEVE_BITS. What is broadcast is bounded by that, however many keys there
    are, so that wide rows are dropped before a shuffled join. Null keys are dropped."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    bits = keys.where(F.col(key).isNotNull()).select(place(F.col(key)).alias("h")).select(F.shiftright("h", 15).alias("_chunk"), F.pmod("h", F.lit(1 << 15)).alias("bit"))
    table = bits.groupBy("_chunk").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    marked = df.where(F.col(key).isNotNull()).withColumn("_place", place(F.col(key))).withColumn("_chunk", F.shiftright("_place", 15))
    at = F.pmod("_place", F.lit(1 << 15)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1), F.lit(1))), 16, 10).cast("int")
    hit = marked.join(F.broadcast(table), "_chunk").where(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1)
    return hit.select(*df.columns)


def skew_lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None, hot_keys: int = 1000, rows: int | None = None) -> DataFrame:
    """left ⟕ right on `key`, where right has one row per key and left may have a key on a third of its rows.

    Keys that hold more than 1/hot_keys of left's rows number fewer than hot_keys, so their rows of right are
    broadcast with that proven bound; all other keys are joined by a shuffle. `hot` may give the hot keys (a
    DataFrame of one column `key`, at most hot_keys rows); rows: how many rows left has, if that is known. Null keys find
    nothing. No row is dropped.
    """
    if hot is None:
        counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
        total = left.count() if rows is None else rows
        if total < 100_000:  # one task would hold it
            return left.join(right, key, "left")
        hot = counts.where(F.col("count") * hot_keys > total).select(key)
    found = hot.collect()  # fewer than hot_keys, by the rule above
    if not found:
        return left.join(right, key, "left")
    values = [r[0] for r in found]
    is_hot = F.coalesce(F.col(key).isin(values), F.lit(False))
    small = F.broadcast(right.where(F.col(key).isin(values)))
    return left.where(is_hot).join(small, key, "left").unionByName(left.where(~is_hot).join(right, key, "left"))


def _chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df sorted over all tasks at once, with the task of each row: a key with a third of all rows is held by many."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()), "chunks")


def _with_earlier(parts: DataFrame, keys: list[str], per: DataFrame, earlier: dict[str, Column]) -> DataFrame:
    """parts with columns that tell of the rows of its keys in earlier chunks. per: keys, _chunk and aggregates."""
    names = [*keys, "_chunk"]
    told = per.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(names)), *(c.alias(n) for n, c in earlier.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(names)]
    return parts.join(told, same, "left").drop(*(f"_o{i}" for i in range(len(names))))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with `out`: the row's place from 1 among those of its keys, by `order`, which must tell all rows apart.

    Rows are sorted over all tasks at once, counted by key and task, and numbered from what came in tasks before.
    """
    parts = _chunks(df, keys, order)
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_earlier(parts, keys, parts.groupBy(*keys, "_chunk").count(), {"_offset": F.coalesce(F.sum("count").over(past), F.lit(0))})
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return joined.withColumn(out, (F.row_number().over(within) + F.col("_offset")).cast("bigint")).drop("_chunk", "_offset")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """df with a running aggregate for each of `values`, name to ('sum' or 'min', value), by `order`, which must tell all
    rows of a key apart. before: of the rows before this one only, null for the first.

    As ranked(): what a task's rows add to comes from aggregates of the tasks before, so that no task holds a hot key.
    """
    parts = _chunks(df.withColumns({f"_v{i}": v for i, (_, v) in enumerate(values.values())}), keys, order)
    how = {"sum": F.sum, "min": F.min}
    kinds = [kind for kind, _ in values.values()]
    per = parts.groupBy(*keys, "_chunk").agg(*(how[k](f"_v{i}").alias(f"_a{i}") for i, k in enumerate(kinds)))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_earlier(parts, keys, per, {f"_p{i}": how[k](f"_a{i}").over(past) for i, k in enumerate(kinds)})
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def total(i: int, kind: str) -> Column:
        here, past = how[kind](f"_v{i}").over(within), F.col(f"_p{i}")
        return F.least(here, past) if kind == "min" else F.when(here.isNotNull() | past.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)))

    return joined.select(*df.columns, *(total(i, k).alias(n) for i, (n, k) in enumerate(zip(values, kinds))))


__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "cut", "discard", "ranked", "running", "scratch_dir", "seen_of", "shared_dir", "ship", "sieved", "skew_lookup"]
