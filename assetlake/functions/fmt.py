"""Figures as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_bytes(n: Column) -> Column:
    """A number of bytes in B, KB, MB, GB or TB with one digit, whole for bytes."""
    x = n.cast("double")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", x / float(1024**k)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", x / float(1024**4)), F.lit(" TB")))


def fmt_duration(seconds: Column) -> Column:
    """`45s`, `3m 5s` or `2h 3m`; fractions are dropped."""
    s = F.floor(seconds).cast("bigint")
    whole = lambda n: F.floor(s / F.lit(n)).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", whole(60), s % 60))
        .otherwise(F.format_string("%dh %dm", whole(3600), whole(60) % 60))
    )


def confidence_bucket(c: Column) -> Column:
    return F.when(c > 0.7, "high").when(c >= 0.3, "medium").otherwise("low")


def shorten(text: Column, most: int) -> Column:
    """The end of a text that is too long, behind an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.lit("…"), F.right(text, F.lit(most - 1)))).otherwise(text)
