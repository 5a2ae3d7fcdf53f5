"""Metadata of images, videos and audio files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import rules
from assetlake.functions.paths import sanitize


def screenshot_size(w: Column, h: Column, sizes: tuple, tolerance: int) -> Column:
    """Whether a size is that of a known screen, in either orientation, within the tolerance."""
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sizes))
    near = lambda x, y: F.abs(x - y) <= tolerance
    return F.coalesce(F.exists(table, lambda r: (near(w, r["a"]) & near(h, r["b"])) | (near(w, r["b"]) & near(h, r["a"]))), F.lit(False))


def display_ratio(w: Column, h: Column) -> Column:
    """Whether a size is a whole multiple of a display's ratio, in either orientation."""
    fits = F.lit(False)
    for a, b in rules.DISPLAY_RATIOS:
        for x, y in ((a, b), (b, a)):
            fits = fits | ((w % x == 0) & (h % y == 0) & (w * y == h * x))
    return F.coalesce((w > 0) & (h > 0) & fits, F.lit(False))


def _joined(make: Column, model: Column) -> Column:
    return F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat(make, F.lit(" - "), model))


def make_model_label(make: Column, model: Column) -> Column:
    """`Make - Model` for paths, without a make that the model repeats; null only if both are null."""
    a, b = F.trim(make), F.trim(model)
    return F.when(make.isNotNull() | model.isNotNull(), sanitize(F.coalesce(_joined(a, b), a, b)))


def camera_key(make: Column, model: Column) -> Column:
    """`Make - Model` for grouping; null if both are null or blank."""
    a, b = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    return F.coalesce(_joined(a, b), a, b)


def exif_status(date_original: Column, make: Column, model: Column, anything: Column) -> Column:
    return F.when(date_original.isNotNull() & (make.isNotNull() | model.isNotNull()), "ok").when(anything, "partial").otherwise("none")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees as a decimal, negative south and west; parts are struct(num, den), a zero denominator is 0."""
    part = lambda c: F.when(c["den"] == 0, F.lit(0.0)).otherwise(F.try_divide(c["num"].cast("double"), c["den"].cast("double")))
    size = part(degrees) + part(minutes) / 60.0 + part(seconds) / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -size).otherwise(size)


def year_tag(tag: Column) -> Column:
    """Year of an audio tag: the number before the first dash, from 1900 to 2100."""
    y = F.trim(F.split_part(tag, F.lit("-"), F.lit(1))).try_cast("int")
    return F.when(y.between(1900, 2100), y)


def mp4_time(seconds: Column) -> Column:
    """Seconds since 1904 as a timestamp; null if not after 1970."""
    return F.when(seconds > 2082844800, F.timestamp_seconds(seconds - 2082844800))


def looks_like_encoder(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(rules.ENCODER_WORDS)), F.lit(False))


def fit_within(w: Column, h: Column, most_w: int, most_h: int) -> Column:
    """struct(w, h) of a size shrunk into a box; never enlarged, no side below 1."""
    ratio = F.least(F.lit(float(most_w)) / w, F.lit(float(most_h)) / h)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * ratio).cast("int"))
    inside = (w <= most_w) & (h <= most_h)
    return F.struct(F.when(inside, w).otherwise(side(w)).alias("w"), F.when(inside, h).otherwise(side(h)).alias("h"))


def oriented(w: Column, h: Column, orientation: Column) -> Column:
    """struct(w, h) as shown: orientations 5 to 8 lie on their side."""
    turned = F.coalesce(orientation.isin(5, 6, 7, 8), F.lit(False))
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def top_tag(tags: Column) -> Column:
    """The name of the tag with the greatest count, the first among equals; tags without a name don't count. tags:
    array<struct<name, count>>."""
    named = F.filter(tags, lambda t: F.coalesce(t["name"], F.lit("")) != "")
    ranked = F.transform(named, lambda t, i: F.struct(F.coalesce(t["count"].cast("bigint"), F.lit(0)).alias("n"), (-i).alias("i"), t["name"].alias("name")))
    return F.array_max(ranked)["name"]


def first_named(items: Column, field: str) -> Column:
    """The first value of a field of an array of structs that isn't null or empty."""
    return F.get(F.filter(F.transform(items, lambda x: x[field]), lambda v: F.coalesce(v, F.lit("")) != ""), 0)


def first_year(dates: Column) -> Column:
    """The first year from 1900 to 2100 among dates written year first."""
    return F.get(F.filter(F.transform(dates, year_tag), lambda y: y.isNotNull()), 0)
