"""Evaluation texts that leak into training text.

A MinHash containment search: each text stands for the hashes of its shingles of five words, of which a sketch keeps
those below a threshold, so that the share of an item's sketch found in a document estimates the share of the item that
it contains, however long the document is. Items are partitioned by size, counted in the shingles that the least leak of
them shares; a partition's threshold is the one at which no hash of such a leak is kept with a probability of at most
MISS. Both sides are thinned by it: items by that of their partition, documents by the highest of the partitions there
are. A document that shares a kept hash with an item is a candidate, and is verified by exact containment of shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.binding import let
from assetlake.functions.text import plain_text, words_of
from assetlake.runtime import bounded_broadcast, cut, sieved

SHINGLE = 5
#: Share of an item's words that a leak covers at least.
COVERED = 1 / 3
#: Probability that the sketch of an item misses a document that holds a leak of it.
MISS = 1e-9


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words, in order; none for fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def threshold(least: int, miss: float = MISS) -> float:
    """The share of hashes that a sketch keeps, so that of `least` or more none is kept with a probability of `miss`."""
    return 1 - miss ** (1 / least)


def _rank(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def item_sketches(items: DataFrame, item_id: str, text: str, miss: float = MISS) -> DataFrame:
    """item_id, h: the hashes that the sketches of items keep, with keep, the threshold of the item's partition.

    The least leak of an item has the fewest different shingles that can cover a third of its words: a shingle that
    stands in c places covers 5 c words at most, so that they are counted from the most frequent one on.
    """
    w = items.where(f"{item_id} is not null").select(F.col(item_id).alias("item_id"), words_of(plain_text(text)).alias("w")).where(F.size("w") >= SHINGLE)
    h = w.select("item_id", F.size("w").alias("n"), F.explode(shingle_hashes(F.col("w"))).alias("h"))
    counts = h.groupBy("item_id", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    # How often shingles stand c times, c descending: few values, however long the item.
    often = counts.groupBy("item_id", "n", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("item_id", "n").agg(F.reverse(F.sort_array(F.collect_list(F.struct("c", "m")))).alias("cs"))

    def step(acc: Column, x: Column) -> Column:
        lack = F.greatest(F.lit(0.0), acc["lack"])
        use = F.least(x["m"].cast("double"), F.ceil(lack / (x["c"] * SHINGLE)).cast("double"))
        return F.struct((lack - use * x["c"] * SHINGLE).alias("lack"), (acc["least"] + use).alias("least"))

    start = F.struct((F.col("n") * COVERED).cast("double").alias("lack"), F.lit(0.0).alias("least"))
    least = often.select("item_id", F.greatest(F.lit(1.0), F.aggregate("cs", start, step)["least"]).alias("least"))
    # Partitions by powers of two; the smallest size of a partition sets its threshold.
    size = F.floor(F.log2("least")).cast("int")
    keep = F.element_at(F.array(*(F.lit(threshold(2**k, miss)) for k in range(40))), size + 1)
    kept = counts.select("item_id", "h").join(least.select("item_id", keep.alias("keep")), "item_id")
    return kept.where(_rank(F.col("h")) < F.col("keep"))


def leak_candidates(items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """(item_id, doc_id) of each item and document that share a hash of the item's sketch."""
    sketch = cut(item_sketches(items, item_id, text, miss), "sketches")
    most = sketch.agg(F.max("keep")).first()[0]
    # The words are a column of their own, as an expression inside a lambda is evaluated anew for each shingle.
    words = documents.where(f"{doc_id} is not null").select(F.col(doc_id).alias("doc_id"), words_of(plain_text(text)).alias("w"))
    found = words.select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("h")).where(_rank(F.col("h")) < F.lit(most if most is not None else 0.0))
    return found.join(bounded_broadcast(sketch.select("item_id", "h")), "h").select("item_id", "doc_id").distinct()


def leaked_items(items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """(item_id, doc_id) of each item and document where runs of five or more consecutive words of the item, as they
    stand in the document, together cover at least a third of the item's words.

    Case, punctuation, spacing, markup and compatible character forms make no difference. Items of fewer than five
    words, null ids and null or empty texts give no rows; repeated rows give one. The document side is exploded to
    hashes only; texts are read again for candidates only, whose ids sieve them before any shuffle.
    """
    candidates = cut(leak_candidates(items, documents, item_id, doc_id, text, miss), "candidates")
    whole = items.where(f"{item_id} is not null").select(F.col(item_id).alias("item_id"), words_of(plain_text(text)).alias("w"))
    whole = cut(whole.where(F.size("w") >= SHINGLE).select("item_id", "w").distinct(), "items")
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = sieved(named, "doc_id", candidates).select("doc_id", plain_text("text").alias("plain"))
    pairs = docs.join(bounded_broadcast(candidates), "doc_id").join(bounded_broadcast(whole), "item_id")
    places = F.filter(
        F.sequence(F.lit(0), F.size("w") - SHINGLE),
        lambda i: F.contains(F.col("plain"), F.concat(F.lit(" "), F.array_join(F.slice("w", i + 1, SHINGLE), " "), F.lit(" "))),
    )
    return pairs.where(_covered(places) * 3 >= F.size("w")).select("item_id", "doc_id").distinct()


def _covered(places: Column) -> Column:
    """Words covered by the shingles at these places: each adds what the one before it doesn't cover."""
    return let(F.sort_array(places), _span)


def _span(ordered: Column) -> Column:
    gaps = F.transform(ordered, lambda x, i: F.when(i == 0, F.lit(SHINGLE)).otherwise(F.least(F.lit(SHINGLE), x - F.get(ordered, i - 1))))
    return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
