"""Dates in file names and metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.config import DATE_PATTERNS
from assetlake.functions.binding import let
from assetlake.functions.paths import basename, parent_name


def name_date(text: Column, confidence: float, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """struct(date timestamp_ntz, confidence) of the first pattern whose first match is a date; null if none is.

    A pattern that puts the day before month and year is half as sure if both could be a month.
    """
    return let(text, lambda t: F.when(t.rlike(r"\d{4}"), F.coalesce(*(_tried(t, confidence, p) for p in patterns))))


def _tried(text: Column, confidence: float, pattern: str) -> Column:
    at = {m: k for k, m in enumerate(re.findall(r"\(\?P<(\w)>", pattern), 1)}
    java = re.sub(r"\(\?P<\w>", "(", pattern)
    order = [m for m in at if m in "Ymd"]
    parts = F.array(*(F.regexp_extract(text, java, at[m]).try_cast("int") if m in at else F.lit(0) for m in "YmdHMS"))
    return F.when(text.rlike(java), _bound(parts, confidence, order[0]))


def _bound(parts: Column, confidence: float, first: str) -> Column:
    return let(parts, lambda g: _dated(*(F.get(g, k) for k in range(6)), confidence, first))


def _dated(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, confidence: float, first: str) -> Column:
    sane = y.between(1900, 2100) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    sure = F.when((d <= 12) & (mo <= 12), confidence * 0.5).otherwise(confidence) if first == "d" else F.lit(confidence)
    made = let(F.when(sane, F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(8,6)"))), lambda x: F.when(x.isNotNull(), F.struct(x.alias("date"), sure.alias("confidence"))))
    return made


def exif_date(text: Column) -> Column:
    """timestamp_ntz of a metadata date in one of five forms; null for others, blanks and 0000 dates."""
    t = F.trim(text)
    day, clock = r"\d{4}[:-]\d{1,2}[:-]\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
    forms = {
        rf"^\d{{4}}:\d{{1,2}}:\d{{1,2}} {clock}$": "y:M:d H:m:s", r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}$": "y:M:d H:m",
        rf"^{day} {clock}$": "y-M-d H:m:s", rf"^{day}T{clock}$": "y-M-d'T'H:m:s", r"^\d{4}:\d{1,2}:\d{1,2}$": "y:M:d",
    }
    parsed = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for shape, f in forms.items()]
    return F.when(~t.startswith("0000"), F.coalesce(*parsed))


def tool_date(text: Column) -> Column:
    """As exif_date, of what metadata tools print: an offset or Z at the end, and fractions, are dropped."""
    return exif_date(F.regexp_replace(F.trim(text), r"(\.\d{1,6})?\s*(Z|[+-]\d{2}:?\d{2})?$", ""))


def date_result(metadata: Column, path: Column, nearby: Column | None = None) -> Column:
    """struct(date, source, confidence): of metadata (1.0), else the file name (0.8), the folder name (0.6), or the
    files beside it (0.3); source none and a null date if nothing tells."""
    tier = lambda c, date, source, sure: F.when(c, F.struct(date.alias("date"), F.lit(source).alias("source"), sure.alias("confidence")))
    name, folder = name_date(basename(path), 0.8), name_date(parent_name(path), 0.6)
    tiers = [
        tier(metadata.isNotNull(), metadata, "metadata", F.lit(1.0)),
        tier(name.isNotNull(), name["date"], "parsed", name["confidence"]),
        tier(folder.isNotNull(), folder["date"], "parsed", folder["confidence"]),
    ]
    if nearby is not None:
        tiers.append(tier(nearby.isNotNull(), nearby, "inferred", F.lit(0.3)))
    nothing = F.struct(F.lit(None).cast("timestamp_ntz").alias("date"), F.lit("none").alias("source"), F.lit(0.0).alias("confidence"))
    return F.coalesce(*tiers, nothing)


__all__ = ["date_result", "exif_date", "name_date", "tool_date"]
