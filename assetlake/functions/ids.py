"""Values that are compared however they were written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", ""))


def norm_id(c: Column | str) -> Column:
    """File, group and session ids: lower case without surrounding blanks; blank is null."""
    return F.nullif(_trimmed(c), F.lit(""))


def norm_hash(c: Column | str) -> Column:
    """Content hashes: as norm_id, without a prefix that names the algorithm (sha256:, sha-256=) or the base (0x)."""
    return F.nullif(F.regexp_replace(_trimmed(c), r"^(sha-?256[:=]\s*)?(0x)?", ""), F.lit(""))


def phash_bits(c: Column | str) -> Column:
    """A perceptual hash as a signed 64-bit number; leading zeros may be missing. Null unless 1 to 16 hex digits."""
    digits = F.regexp_replace(_trimmed(c), r"^(phash[:=]\s*)?(0x)?", "")
    full = F.lpad(digits, 16, "0")
    # Two halves: a hex text above 2**63 doesn't fit a signed cast.
    half = lambda start: F.conv(F.substring(full, start, 8), 16, 10).cast("bigint")
    return F.when(digits.rlike(r"^[0-9a-f]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))
