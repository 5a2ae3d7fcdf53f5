"""Pairs of similar 64-bit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions.ids import hamming64


def similar_codes(codes: DataFrame, least: float = 0.95, member: str = "id", code: str = "bits") -> DataFrame:
    """(code_a, code_b, similarity) of distinct codes with 1 - hamming / 64 >= least, code_a < code_b.

    Within k = floor(64 * (1 - least)) bits at least one of k + 1 bands is equal: an equi-join on bands finds every
    pair, and a pair counts at the first band that its codes share. Copies of a code are not paired; see
    code_members(). Beyond k = 31 the bands would be single bits: a lower threshold is refused.
    """
    k = int(64 * (1 - least) + 1e-9)
    if k > 31:
        raise ValueError("least must be above 0.5")
    edges = [64 * i // (k + 1) for i in range(k + 2)]
    mask = lambda i: F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("bigint")
    band = lambda c, i: F.shiftrightunsigned(c, edges[i]).bitwiseAND(mask(i))
    d = codes.where(f"{code} is not null").select(F.col(code).alias("bits")).distinct()
    keys = F.array(*(F.struct(F.lit(i).alias("n"), band(F.col("bits"), i).alias("band")) for i in range(k + 1)))
    a = d.select(F.explode(keys).alias("k"), F.col("bits").alias("code_a")).select("k.*", "code_a")
    b = a.select("n", "band", F.col("code_a").alias("code_b"))
    x = F.col("code_a").bitwiseXOR(F.col("code_b"))
    # The first equal band: all before it differ.
    first = F.array_position(F.array(*(band(x, i) == 0 for i in range(k + 1))), True) - 1
    similarity = 1 - hamming64(F.col("code_a"), F.col("code_b")) / F.lit(64.0)
    near = a.join(b, ["n", "band"]).where("code_a < code_b").where(hamming64(F.col("code_a"), F.col("code_b")) <= k)
    return near.where(first == F.col("n")).select("code_a", "code_b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def code_members(codes: DataFrame, member: str = "id", code: str = "bits") -> DataFrame:
    """(bits, member): the files of each code."""
    return codes.where(f"{code} is not null").select(F.col(code).alias("bits"), member)
