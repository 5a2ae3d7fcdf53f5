"""Filling containers of fixed capacity with items: vector bin packing by the dot-product heuristic.

An item has a demand in each of three resources (tokens, segments, loss-bearing tokens), a container a limit in each.
The open container takes, among the items that fit in all of them, the one whose demand has the greatest dot product
with what is left, so that items are preferred that use up what is plentiful. Once half of its tokens are taken, items
that close it are scored the same way: one, or two taken as one demand, whose tokens are all that is left. Items are
spread at random over shards of a bounded size that are packed apart, a task each: what is lost is at most a part of the
last containers of each shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items of a shard, about.
SHARD_ITEMS = 20_000


def byte_tokens(text: Column | str) -> Column:
    """Tokens of the public ByT5 tokenizer: one per UTF-8 byte and one end token. Null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def pack_shard(demand: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Container number of each item. demand: items x resources; limit: resources. An item beyond a limit gets a container
    of its own."""
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.reshape(-1)
    waiting = [list(x) for x in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])]
    left = np.bincount(of)
    weight = 1.0 / limit
    scaled = kinds * weight
    tokens = kinds[:, 0]
    least = kinds.min(axis=0, initial=limit.max())
    first = {}  # tokens to the kinds of that size
    for k, t in enumerate(tokens.tolist()):
        first.setdefault(t, []).append(k)
    sizes = np.zeros(int(max(limit[0], tokens.max(initial=0))) + 1, bool)
    sizes[tokens] = True
    out = np.empty(len(demand), np.int64)
    bin_no, remaining = 0, len(demand)
    room = limit.copy()
    empty = True

    def put(k: int) -> None:
        nonlocal room, remaining, empty
        out[waiting[k].pop()] = bin_no
        left[k] -= 1
        remaining -= 1
        room = room - kinds[k]
        empty = False
        if not left[k]:
            t = int(tokens[k])
            first[t] = [x for x in first[t] if x != k]
            if not first[t]:
                sizes[t] = False

    def one(t: int) -> int | None:
        """The kind of t tokens that fits and has the greatest dot product with what is left."""
        fit = [k for k in first.get(t, ()) if (kinds[k] <= room).all()]
        return max(fit, key=lambda k: (scaled[k] @ (room * weight), -k)) if fit else None

    def two(r: int) -> tuple[int, int] | None:
        """Two kinds of r tokens together that fit, the greater tokens first. Those of equal tokens have the same dot
        product but for segments and loss, so that the first pair that fits is taken."""
        smaller = np.flatnonzero(sizes[1 : r // 2 + 1] & sizes[r - 1 : r - 1 - r // 2 : -1]) + 1 if r > 1 else ()
        for a in map(int, smaller[::-1]):
            for x in first[r - a]:
                rest = room - kinds[x]
                if (rest >= 0).all():
                    for y in first[a]:
                        if (kinds[y] <= rest).all() and (x != y or left[x] > 1):
                            return x, y
        return None

    while remaining:
        r = int(room[0])
        if not empty and r > 0:
            k = one(r)
            if k is not None:
                put(k)
                continue
            pair = two(r) if r < limit[0] // 2 and (2 * least <= room).all() else None
            if pair is not None:
                for k in pair:
                    put(k)
                continue
        fits = (left > 0) & (kinds <= room).all(axis=1)
        if not fits.any():
            if empty:  # larger than a container: alone in one
                put(int(np.flatnonzero(left)[0]))
            bin_no += 1
            room, empty = limit.copy(), True
            continue
        score = np.where(fits, scaled @ (room * weight), -1.0)
        put(int(score.argmax()))
    return out


def pack_items(items: DataFrame, limits: tuple[int, int, int], shard_items: int = SHARD_ITEMS, count: int | None = None) -> DataFrame:
    """items with container_id. items: tokens, segments, loss_tokens (bigint, each within its limit) and any others.

    Repeated rows are items of their own. An empty input gives no rows. count: about how many items there are, if that is
    known already. Which shard an item falls into depends on its row only, so that a task that is run again gives the
    same containers.
    """
    shards = max(1, -(-(items.count() if count is None else count) // shard_items))
    limit = np.array(limits, np.int64)
    names = items.columns

    def pack(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        for shard, pdf in pd.concat(parts, ignore_index=True).groupby("_shard", sort=True):
            pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
            bins = pack_shard(pdf[["tokens", "segments", "loss_tokens"]].to_numpy(np.int64), limit)
            pdf["container_id"] = [f"{shard}-{b}" for b in bins]
            yield pdf[[*names, "container_id"]]

    order = [c for c, t in items.dtypes if t in ("bigint", "int", "string")]
    sharded = items.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    schema = T.StructType([*items.schema.fields, T.StructField("container_id", T.StringType())])
    # Each shard is a partition by its number: a task holds one shard, of a bounded size.
    return sharded.repartitionById(shards, F.col("_shard")).mapInPandas(pack, schema)


def split_documents(documents: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", loss_tokens: int | None = None, prompt: Column | None = None) -> DataFrame:
    """(doc_id, piece from 0, start, tokens): each document whole if it fits, else in pieces of at most `capacity`
    tokens that end between characters. start is the byte at which the piece begins; the last has the end token. With
    a prompt (bytes that bear no loss) a document fits if what follows it is within loss_tokens too, and pieces are."""
    raw = F.encode(F.col(text), "utf-8")
    total = byte_tokens(F.col(text))
    step = min(capacity, loss_tokens or capacity) - 3  # a character has at most four bytes
    bare = F.lit(0) if prompt is None else prompt
    d = documents.select(F.col(doc_id).alias("doc_id"), raw.alias("raw"), total.alias("total"), (total - bare).alias("loss"))
    fits = (F.col("total") <= capacity) & (F.col("loss") <= (loss_tokens or capacity))
    d = d.withColumn("n", F.when(fits, F.lit(1)).otherwise(F.ceil(F.col("total") / step)).cast("int")).select("doc_id", "raw", "total", "n")

    def begin(k: Column) -> Column:
        """Byte k * step, or the start of the character that it lies in."""
        inside = lambda at: F.hex(F.substring("raw", (at + 1).cast("int"), F.lit(1))).between("80", "BF")
        at = k * step
        back = F.when(~inside(at), 0).when(~inside(at - 1), 1).when(~inside(at - 2), 2).otherwise(3)
        return F.when(k == 0, F.lit(0)).when(k >= F.col("n"), F.col("total")).otherwise(at - back).cast("bigint")

    starts = F.transform(F.sequence(F.lit(0), F.col("n")), begin)
    d = d.select("doc_id", "n", starts.alias("starts")).select("doc_id", "starts", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    return d.select("doc_id", "piece", F.get("starts", F.col("piece")).alias("start"), (F.get("starts", F.col("piece") + 1) - F.get("starts", F.col("piece"))).alias("tokens"))


def pack_documents(documents: DataFrame, capacity: int = 4096, segments: int = 256, loss_tokens: int | None = None, prompt: Column | None = None) -> DataFrame:
    """(container_id, doc_id, piece, start, tokens, loss_tokens): each document, or each piece of one larger than a
    container, in a container. prompt: the bytes at the start of a document that bear no loss; none unless given, so
    that the limit of loss is the capacity unless given.

    A null text counts as empty and takes its end token; a null doc_id is an item like any other.
    """
    bare = F.lit(0) if prompt is None else F.coalesce(prompt, F.lit(0))
    # The key of a document is carried with the bytes of its prompt, so that the pieces know both.
    d = documents.select(F.struct(F.col("doc_id").alias("id"), bare.cast("bigint").alias("bare")).alias("doc_id"), "text")
    pieces = split_documents(d, capacity, loss_tokens=loss_tokens, prompt=F.col("doc_id.bare")).select(F.col("doc_id.id").alias("doc_id"), "piece", "start", "tokens", F.col("doc_id.bare").alias("bare"))
    loss = F.greatest(F.lit(0), F.col("start") + F.col("tokens") - F.greatest("start", "bare")).cast("bigint")
    items = pieces.select("doc_id", "piece", "start", "tokens", F.lit(1).cast("bigint").alias("segments"), loss.alias("loss_tokens"))
    # Pieces of documents larger than a container are few, so that the number of documents (told by the files' footers) tells the shards.
    packed = pack_items(items, (capacity, segments, loss_tokens or capacity), count=documents.count())
    return packed.select("container_id", "doc_id", "piece", "start", "tokens", "loss_tokens")


def packing_proof(packed: DataFrame, capacity: int = 4096, segments: int = 256, loss_tokens: int | None = None) -> DataFrame:
    """One row: documents, tokens, loss_tokens (of all pieces), overfull (containers over any limit), gaps (documents whose
    pieces don't follow each other), tight (at most 2 % and one container above the least number that each limit alone allows)."""
    limits = (capacity, segments, loss_tokens or capacity)
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss_tokens").alias("l"))
    over = (F.col("t") > limits[0]) | (F.col("s") > limits[1]) | (F.col("l") > limits[2])
    least = F.greatest(*(F.ceil(F.sum(c) / n) for c, n in zip("tsl", limits)))
    bins = per.agg(F.count_if(over).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(least * 1.02) + 1).alias("tight"), F.sum("t").alias("tokens"), F.sum("l").alias("loss_tokens"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("piece").alias("last"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("last") + 1) | (F.col("t") != F.col("end"))).alias("gaps"))
    return bins.crossJoin(docs).select("documents", "tokens", "loss_tokens", "overfull", "gaps", "tight")  # one row each


def split_ids(packed: DataFrame) -> DataFrame:
    """doc_id of the documents that pack_documents had to split."""
    return packed.groupBy("doc_id").agg(F.max("piece").alias("last")).where("last > 0").select("doc_id")


def container_fill(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, tokens, unused share of all containers, and the least number of containers there could be."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"),
        (1 - F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("unused"), F.ceil(F.sum("t") / capacity).alias("least"),
    )
