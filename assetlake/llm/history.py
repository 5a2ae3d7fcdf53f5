"""Deduplicating new batches against all history.

History is kept as an inverted file: a vector (a 64-bit perceptual hash) lies, whole, in one cell of each of several
coarse quantizers, each of which sees some of its bands of bits. Two vectors that share no cell differ in more than
`radius` bits, by the number of bands: that is the distance bound after which no nearer match is possible, so that a
probe reads its own cells only, reranks exactly what lies there, and misses nothing. Cells that hold too many vectors are
split by more of the bits that their quantizer doesn't see, under the same bound. New batches are appended to their
cells under a path; what is stored isn't read again for it.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.functions.ids import norm_hash, phash_bits
from assetlake.functions.records import current_records, current_sessions
from assetlake.runtime import bounded_broadcast, cut, scratch_dir

#: Vectors that a cell should hold on average, at most; decides how many bands a quantizer sees.
CELL_VECTORS = 16
#: A cell of more vectors is split, at most so many times: each time there are four quantizers for one.
HOT_CELL, SPLITS = 4096, 2
#: Folders that the cells of an index are spread over; a batch reads those that it probes.
BUCKETS = 64

#: What a quantizer sees: runs of bits (first bit, width).
Quantizer = list[tuple[int, int]]


def bands_for(vectors: int, radius: int, bits: int = 64) -> int:
    """How many bands a quantizer sees: the least number for which a cell holds CELL_VECTORS of evenly spread vectors."""
    for r in range(1, bits - radius):
        if vectors / 2.0 ** (bits * r / (radius + r)) <= CELL_VECTORS:
            return r
    return bits - radius


def quantizers(r: int, radius: int, bits: int = 64) -> list[Quantizer]:
    """With radius + r bands, two vectors within the radius agree in at least r of them: each choice of r bands is a
    quantizer."""
    n = radius + r
    edges = [bits * k // n for k in range(n + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(edges, edges[1:])], r)]


def split_quantizer(q: Quantizer, radius: int, bits: int = 64) -> list[Quantizer]:
    """Quantizers that see more: what q doesn't see is divided into radius + 1 parts, of which two vectors within the
    radius that share q's cell agree in one. Empty if there is nothing left to see."""
    seen = {b for at, width in q for b in range(at, at + width)}
    hidden = [b for b in range(bits) if b not in seen]
    edges = [len(hidden) * k // (radius + 1) for k in range(radius + 2)]
    parts = [hidden[a:b] for a, b in zip(edges, edges[1:])]
    return [[*q, *_runs(part)] for part in parts] if all(parts) else []


def _runs(positions: list[int]) -> Quantizer:
    out: Quantizer = []
    for b in positions:
        if out and sum(out[-1]) == b:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


def cells_of(vector: Column, q: list[Quantizer]) -> Column:
    """array of struct(quantizer, cell) of a vector."""

    def cell(bands: Quantizer) -> Column:
        out = F.lit(0).cast("bigint")
        for at, width in bands:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(vector, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        return out

    return F.array(*(F.struct(F.lit(k).alias("quantizer"), cell(b).alias("cell")) for k, b in enumerate(q)))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("quantizer", "cell"), F.lit(BUCKETS)).cast("int").alias("bucket")


class CellIndex:
    """An inverted file of 64-bit vectors under a path, opened if it is there. Cells are only ever appended to; once
    there are so many vectors that cells are too full, those stored are written anew, once for each further band.

    Writers take turns: an append that is cut off leaves a folder that the index doesn't list, and is run again.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = 3):
        self.spark, self.path, self.radius = spark, path.rstrip("/"), radius
        self.r, self.vectors, self.parts = 0, 0, []
        if self._exists(f"{self.path}/state"):
            state = self.spark.read.json(f"{self.path}/state").orderBy(F.desc("version")).first()
            if state["radius"] != radius:
                raise ValueError(f"the index has radius {state['radius']}")
            self.r, self.vectors, self.parts = state["r"], state["vectors"], list(state["parts"] or [])

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _cells(self, vectors: DataFrame) -> DataFrame:
        rest = [c for c in vectors.columns if c != "bits"]
        return vectors.select(F.explode(cells_of(F.col("bits"), quantizers(self.r, self.radius))).alias("c"), "bits", *rest).select("c.*", "bits", *rest)

    def append(self, vectors: DataFrame, count: int | None = None) -> None:
        """vectors: bits and payload columns, of the same names each time; count: how many, if that is known."""
        count = vectors.count() if count is None else count
        r = max(self.r, bands_for(self.vectors + count, self.radius))
        if self.parts and r > self.r:
            old = self._read().where("quantizer = 0").drop("quantizer", "cell", "bucket")
            self.r, self.parts = r, []
            self._write(old)
        self.r = r
        self._write(vectors)
        self.vectors += count
        state = self.spark.createDataFrame([(len(self.parts) + self.vectors, self.radius, self.r, self.vectors, self.parts)], "version bigint, radius int, r int, vectors bigint, parts array<string>")
        state.coalesce(1).write.mode("append").json(f"{self.path}/state")

    def _write(self, vectors: DataFrame) -> None:
        part = f"{self.path}/cells/{self.r}-{uuid.uuid4().hex}"
        cells = self._cells(vectors).select("*", _bucket())
        cells.repartition(F.col("bucket"), F.pmod(F.xxhash64("cell"), F.lit(8))).sortWithinPartitions("bucket", "quantizer", "cell").write.partitionBy("bucket").parquet(part)
        self.parts.append(part)

    def _read(self) -> DataFrame:
        out = None
        for part in self.parts:
            df = self.spark.read.parquet(part)
            out = df if out is None else out.unionByName(df)
        return out

    def probe(self, queries: DataFrame, keep: Column) -> DataFrame:
        """(query_bits, bits, payload) of the stored vectors within the radius of a query's, its own too; keep: a
        condition on the payloads, those of queries carrying the prefix q_. queries: bits and payload. A batch reads the
        folders of the cells that it probes."""
        rest = [c for c in queries.columns if c != "bits"]
        asked = self._cells(queries.select("bits", *(F.col(c).alias(f"q_{c}") for c in rest))).withColumnRenamed("bits", "query_bits").select("*", _bucket())
        asked = cut(asked, "probes")
        folders = [x[0] for x in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        stored = self._read().where(F.col("bucket").isin(folders))
        payload = [c for c in stored.columns if c not in ("quantizer", "cell", "bucket", "bits")]
        near = F.bit_count(F.col("bits").bitwiseXOR(F.col("query_bits"))) <= self.radius
        return self._matches(asked.drop("bucket"), stored.drop("bucket"), quantizers(self.r, self.radius), near & keep, SPLITS).select("query_bits", "bits", *payload).distinct()

    def _matches(self, asked: DataFrame, stored: DataFrame, q: list[Quantizer], keep: Column, splits: int) -> DataFrame:
        """Pairs of a cell that `keep` holds for; cells that hold too many vectors are split first. One that still does after
        all splits is joined whole, its rows spread by adaptive skew splitting."""
        finer = [split_quantizer(x, self.radius) for x in q]
        plain = asked.join(stored, ["quantizer", "cell"]).where(keep).drop("quantizer", "cell")
        if not splits or not all(finer):
            return plain
        hot = cut(stored.groupBy("quantizer", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_CELL).select("quantizer", "cell"), "hot")
        if hot.isEmpty():
            return plain
        hot = bounded_broadcast(hot)
        rest = lambda df: df.join(hot, ["quantizer", "cell"], "left_anti")
        cold = rest(asked).join(rest(stored), ["quantizer", "cell"]).where(keep).drop("quantizer", "cell")

        def split(df: DataFrame, bits: str) -> DataFrame:
            """Rows of hot cells in the cells of the finer quantizers of theirs."""
            cells = F.lit(None)
            base = 0
            for k, f in enumerate(finer):
                moved = F.transform(cells_of(F.col(bits), f), lambda c, base=base: F.struct((c["quantizer"] + base).alias("quantizer"), c["cell"].alias("cell")))
                cells = F.when(F.col("quantizer") == k, moved).otherwise(cells)
                base += len(f)
            some = df.join(hot, ["quantizer", "cell"], "left_semi").select(F.explode(cells).alias("c"), *(c for c in df.columns if c not in ("quantizer", "cell")))
            return cut(some.select("c.*", *(c for c in some.columns if c != "c")), "split")

        return cold.unionByName(self._matches(split(asked, "query_bits"), split(stored, "bits"), [x for f in finer for x in f], keep, splits - 1))


class History:
    """What was accepted before, under a path, against which batches are checked one after the other: a batch reads
    the folders of its own hashes and cells, and is appended to them."""

    def __init__(self, spark: SparkSession, root: str, radius: int = 3):
        self.spark, self.root = spark, root.rstrip("/")
        self.index = CellIndex(spark, f"{self.root}/vectors", radius)

    def _key(self) -> Column:
        return F.pmod(F.xxhash64("sha"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def accept(self, hashes: DataFrame) -> None:
        """Appends accepted files: sha256_hash, rel_path, added_at."""
        rows = hashes.select(norm_hash("sha256_hash").alias("sha"), "rel_path", "added_at").where("sha is not null and added_at is not null")
        rows.select("*", self._key()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/accepted")

    def check(self, batch: DataFrame, began) -> DataFrame:
        """(file_id, kind, rel_path) as of repeats_of_history() for the records of a session that began at `began`; batch:
        file_id, sha256_hash, perceptual_hash, one row a record."""
        rows = cut(batch.select("file_id", norm_hash("sha256_hash").alias("sha"), phash_bits("perceptual_hash").alias("bits")).where("sha is not null"), "batch")
        cases = rows.select("file_id", F.lit("exact").alias("kind"), "sha")
        if self.index.parts:
            pairs = self.index.probe(rows.where("bits is not null").select("bits").distinct(), F.lit(True))
            near = rows.join(pairs.select(F.col("query_bits").alias("bits"), F.col("sha").alias("old")).distinct(), "bits").where("old <> sha")
            cases = cases.unionByName(near.select("file_id", F.lit("near").alias("kind"), F.col("old").alias("sha")))
        cases = cut(cases.select("*", self._key()), "cases")
        folders = [x[0] for x in cases.select("bucket").distinct().collect()]  # at most BUCKETS
        known = self.spark.read.schema("sha string, rel_path string, added_at timestamp, bucket int").parquet(f"{self.root}/accepted").where(F.col("bucket").isin(folders) & (F.col("added_at") < F.lit(began)))
        latest = known.groupBy("bucket", "sha").agg(F.max(F.struct("added_at", "rel_path")).alias("a")).select("bucket", "sha", F.col("a.rel_path").alias("rel_path"))
        return cases.join(latest, ["bucket", "sha"]).select("file_id", "kind", "rel_path").distinct()

    def append(self, batch: DataFrame) -> None:
        """Adds the vectors of a batch that was checked to their cells."""
        vectors = batch.select(phash_bits("perceptual_hash").alias("bits"), norm_hash("sha256_hash").alias("sha")).where("bits is not null and sha is not null").distinct()
        self.index.append(cut(vectors, "vectors"))


def slots_of(df: DataFrame, at: str, sessions: DataFrame) -> DataFrame:
    """df with slot: how many sessions began at or before `at`. An as-of join by day: each day has the sessions that
    began on it and the number before it. Rows with a null time are dropped."""
    days = sessions.groupBy(F.to_date("created_at").alias("day")).agg(F.sort_array(F.collect_list("created_at")).alias("times"))
    span = sessions.agg(F.min(F.to_date("created_at")).alias("a"), F.max(F.to_date("created_at")).alias("b"), F.count(F.lit(1)).alias("n"))
    calendar = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    table = calendar.join(days, "day", "left").select("day", F.coalesce("times", F.array().cast("array<timestamp>")).alias("times"))
    table = cut(table.select("day", "times", F.coalesce(F.sum(F.size("times")).over(w), F.lit(0)).alias("before")), "days")
    end = span.first()
    j = df.where(F.col(at).isNotNull()).withColumn("day", F.to_date(at)).join(bounded_broadcast(table), "day", "left")
    inside = F.col("before") + F.size(F.filter("times", lambda x: x <= F.col(at)))
    slot = F.when(F.col("before").isNotNull(), inside).otherwise(F.when(F.col("day") > F.lit(end["b"]), F.lit(end["n"])).otherwise(F.lit(0)))
    return j.withColumn("slot", slot.cast("bigint")).drop("day", "times", "before")


def repeats_of_history(file_records: DataFrame, sessions: DataFrame, hashes: DataFrame, radius: int = 3) -> DataFrame:
    """(file_id, kind, rel_path) of each current record that repeats a file accepted before its session began.

    kind is exact (equal sha256_hash) or near (another sha256_hash, and a perceptual hash within `radius` bits of that
    of a record of an earlier session whose sha256_hash was accepted before). Records without sha256_hash, or of a
    session that isn't in sessions, are no cases. Each session is checked as a batch of its own against what came
    before it; time is kept as the session's place in the order of created_at, so that one pass serves all batches.
    """
    began = cut(current_sessions(sessions).where("created_at is not null").select("session_key", "created_at"), "sessions")
    began_at = slots_of(began, "created_at", began).select("session_key", (F.col("slot") - 1).alias("k"))
    records = current_records(file_records, "session_id", "sha256_hash", "perceptual_hash").select(
        "file_id", F.lower(F.trim("session_id")).alias("session_key"), norm_hash("sha256_hash").alias("sha"), phash_bits("perceptual_hash").alias("bits")
    ).where("sha is not null")
    records = cut(records.join(bounded_broadcast(cut(began_at, "order")), "session_key").select("file_id", "k", "sha", "bits"), "records")
    # An accepted file counts for session k if its slot is at most k.
    accepted = slots_of(hashes.select(norm_hash("sha256_hash").alias("sha"), "rel_path", "added_at").where("sha is not null"), "added_at", began)
    accepted = accepted.groupBy("sha", "slot").agg(F.max(F.struct("added_at", "rel_path")).alias("a")).select("sha", "slot", F.col("a.rel_path").alias("rel_path"))
    accepted = cut(accepted, "accepted")
    first = accepted.groupBy("sha").agg(F.min("slot").alias("first"))
    history = records.where("bits is not null").groupBy("bits", "sha").agg(F.min("k").alias("k")).join(first, "sha")
    history = cut(history.select("bits", "sha", F.greatest(F.col("k") + 1, F.col("first")).alias("since")), "history")
    vectors = cut(history.groupBy("bits").agg(F.min("since").alias("since")), "vectors")
    n = vectors.count()
    if n:
        spark = file_records.sparkSession
        index = CellIndex(spark, scratch_dir(spark, "index"), radius)
        index.append(vectors, n)
        asked = records.where("bits is not null").groupBy("bits").agg(F.max("k").alias("since"))
        pairs = index.probe(asked, F.col("since") <= F.col("q_since")).select("query_bits", "bits")
    else:
        pairs = vectors.select(F.col("bits").alias("query_bits"), "bits")
    told = pairs.join(history.withColumnRenamed("sha", "old"), "bits").select(F.col("query_bits").alias("bits"), "old", "since")
    told = told.groupBy("bits", "old").agg(F.min("since").alias("since"))
    near = records.join(told, "bits").where("since <= k and old <> sha").select("file_id", F.lit("near").alias("kind"), F.col("old").alias("sha"), "k")
    cases = cut(records.select("file_id", F.lit("exact").alias("kind"), "sha", "k").unionByName(near), "cases")
    # The accepted row as of each session: both sides hold at most one row for each hash and session.
    asof = cases.select("sha", "k").distinct().select("sha", F.col("k").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("struct<rel_path:string>").alias("a"))
    rows = accepted.select("sha", F.col("slot").alias("at"), F.lit(0).alias("ask"), F.struct("rel_path").alias("a")).unionByName(asof)
    w = Window.partitionBy("sha").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select("sha", F.col("at").alias("k"), "ask", F.last("a", ignorenulls=True).over(w).alias("a")).where("ask = 1 and a is not null")
    return cases.join(known.select("sha", "k", "a.rel_path"), ["sha", "k"]).select("file_id", "kind", "rel_path").distinct()
