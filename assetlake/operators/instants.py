"""Mixed timestamp texts and zones to one instant in UTC.

Texts are parsed to wall time by native expressions; the zone of the text, or else the zone given beside it, is an
offset or a zone name. Wall times of named zones are joined as of the zone's offset intervals: two intervals that
hold the wall time mean that it is ambiguous, none that it was skipped, one gives the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.binding import let
from assetlake.functions.ids import norm_id
from assetlake.functions.zones import CYCLE, FIRST_YEAR, LAST_YEAR, interval_table

DAY = 24 * 3600
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# Shapes of a date at the start of a text, and how each is written with the year first.
_DATES = {
    r"^(\d{4})[:/](\d{1,2})[:/](\d{1,2})[t ]": "$1-$2-$3 ",
    r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[t ]": "$3-$2-$1 ",
    r"^(\d{1,2})/(\d{1,2})/(\d{4})[t ]": "$3-$1-$2 ",
    r"^(?:[a-z]{3,9},? )?(\d{1,2})[ \-]([a-z]{3})[a-z]*\.?[ \-](\d{4}),? ": "$3-$2-$1 ",
    r"^(\d{4})(\d{2})(\d{2})[t ](\d{2})(\d{2})(\d{2})?": "$1-$2-$3 $4:$5:$6",
}
_ZONE = r"z|utc|gmt|(?:utc|gmt)?[+\-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+\-]+)+"
#: Year, month, day, hour, minute, second, fraction, half of the day, zone.
_SHAPE = rf"^(\d{{4}})-(\d{{1,2}}|[a-z]{{3}})-(\d{{1,2}})[t ](\d{{1,2}}):(\d{{2}})(?::(\d{{2}})?(?:[.,](\d{{1,9}}))?)?(?: ?([ap])\.?m\.?)?(?: ?\[?({_ZONE})\]?)?$"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of an offset as text: Z, UTC, GMT, +H, +HH, +HHMM, +HH:MM, with or without UTC or GMT
    before it. Null for anything else, such as a zone name, and for more than 18 hours or 59 minutes."""
    z = F.lower(F.trim(zone))
    shape = r"^(?:utc|gmt)?\s*([+\-−])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?$"
    h, m, s = (F.coalesce(_int(F.regexp_extract(z, shape, k)), F.lit(0)) for k in (2, 3, 4))
    size = h * 3600 + m * 60 + s
    signed = F.when(F.regexp_extract(z, shape, 1) == "+", size).otherwise(-size)
    return F.when(z.isin("z", "utc", "gmt"), F.lit(0)).when(z.rlike(shape) & (size <= 18 * 3600) & (m < 60) & (s < 60), signed)


def _div(c: Column, n: int) -> Column:
    """c divided by n, rounded down, in whole numbers."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n)).cast("bigint")


def _year(second: Column) -> Column:
    """The year of a wall second; days are counted without regard to the session's time zone."""
    return F.year(F.date_from_unix_date(_div(second, DAY).cast("int")))


def _table_second(s: Column, year: Column) -> Column:
    """The wall second s of a year, or for years after LAST_YEAR that of the year of the table with the same calendar:
    rules for daylight saving go by weekdays, so that it has the same offsets."""
    first = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1)))
    days = lambda y: first(y + 1) - first(y)
    years = F.sequence(F.lit(LAST_YEAR - CYCLE + 1), F.lit(LAST_YEAR))
    same = F.get(F.filter(years, lambda y: ((first(year) - first(y)) % 7 == 0) & (days(y) == days(year))), 0)
    return F.when(year > LAST_YEAR, s - (first(year) - first(same)).cast("bigint") * DAY).otherwise(s)


def _parts(t: Column) -> Column:
    """The nine parts of _SHAPE of a text; of a text of another shape one part."""
    for shape, ordered in _DATES.items():
        t = F.regexp_replace(t, shape, ordered)
    return F.split(F.regexp_replace(t, _SHAPE, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", -1)


def _number(t: Column) -> Column:
    """Microseconds since 1970 in UTC of a bare number of seconds or milliseconds."""
    seconds = t.rlike(r"^-?\d{1,10}$") & ~t.rlike(r"^\d{8}$")
    return F.when(seconds, t.try_cast("bigint") * 1_000_000).when(t.rlike(r"^-?\d{11,13}$"), t.try_cast("bigint") * 1000)


def _clock(p: Column) -> Column:
    """struct(us, said) of the parts of a text: wall-clock microseconds and the zone in the text, null if none."""
    at = lambda k: F.get(p, k)
    month = F.coalesce(_int(at(1)), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), at(1)), F.lit(0)).cast("int"))
    hour = let(_int(at(3)), lambda h: F.when(at(7) == "", h).when(h.between(1, 12), h % 12 + F.when(at(7) == "p", 12).otherwise(0)))
    numbers = F.array(_int(at(0)), month, _int(at(2)), hour, _int(at(4)), F.coalesce(_int(at(5)), F.lit(0)))
    us = F.coalesce(F.substring(F.rpad(at(6), 6, "0"), 1, 6).try_cast("bigint"), F.lit(0))

    def wall(n: Column) -> Column:
        y, mo, d, h, mi, s = (F.get(n, k) for k in range(6))
        # A date without a time zone: no session setting has a part in it.
        day = F.unix_date(F.try_make_timestamp_ntz(y, mo, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")).cast("bigint")
        on_clock = h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
        return F.when(on_clock, (day * DAY + h * 3600 + mi * 60 + s) * 1_000_000)

    return F.when(F.size(p) == 9, F.struct((let(numbers, wall) + us).alias("us"), F.nullif(at(8), F.lit("")).alias("said")))


def wall_time(text: Column) -> Column:
    """struct(us, said, utc): wall-clock microseconds of a text, the zone in it (null if none), and whether us is UTC
    already.

    us is null for values without a time of day, not on the calendar or clock, or of no known shape. Dots mean day
    first, slashes month first unless the year leads. A bare number of up to 10 digits is seconds, of 11 to 13
    milliseconds, since 1970 in UTC; 8 digits are a date without time. Fractions keep six digits. It is one expression in
    which each step is bound once: as a chain of columns the optimizer would write it out anew for each use.
    """
    t = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\s\x00]+", " "), r"^ | $", ""))
    said = lambda n, w: F.struct(F.coalesce(n, w["us"]).alias("us"), w["said"].alias("said"), n.isNotNull().alias("utc"))
    return let(t, lambda t: let(_parts(t), lambda p: let(_clock(p), lambda w: let(_number(t), lambda n: said(n, w)))))


def _zoned(w: Column, zone: Column) -> Column:
    """struct(us, utc, off, named, s, year) of wall_time() and the zone beside it: off is a plain offset, named a zone
    that must be looked up, s and year the second and year of the zone table that it is looked up by."""

    def told(z: Column, off: Column) -> Column:
        named = F.when(off.isNull() & ~w["utc"], z)
        second = F.when(named.isNotNull(), _div(w["us"], 1_000_000))
        at = let(second, lambda s: let(_year(s), lambda y: _table_second(s, y)))
        made = lambda s: F.struct(w["us"].alias("us"), w["utc"].alias("utc"), off.alias("off"), named.alias("named"), s.alias("s"), F.when(s.isNotNull(), F.greatest(_year(s), F.lit(FIRST_YEAR))).alias("year"))
        return let(at, made)

    return let(F.coalesce(w["said"], F.lower(F.trim(zone))), lambda z: let(offset_seconds(z), lambda off: told(z, off)))


def to_instants(df: DataFrame, text: str, zone: str, out: str = "utc_us") -> DataFrame:
    """df with `out`: microseconds since 1970 UTC of the text, null if the text and zone fix no instant.

    A zone in the text goes before the column `zone`, which may hold an offset or a zone name in any case. A wall
    time that occurs twice means the earlier instant, a skipped one is read with the offset before the change. No
    shuffle: the intervals are bounded by the tz database, so that they are broadcast. df may have columns of any name;
    one that is called as `out` is replaced.
    """
    # The row is kept as one column, so that none of its names can clash with another.
    parsed = df.select(F.struct("*").alias("row"), let(wall_time(F.col(text)), lambda w: _zoned(w, F.col(zone))).alias("at"))
    spans = F.broadcast(interval_table(df.sparkSession).toDF("zone_key", "zone_year", "spans"))
    joined = parsed.join(spans, (F.col("at.named") == F.col("zone_key")) & (F.col("at.year") == F.col("zone_year")), "left")

    def instant(at: Column) -> Column:
        s = at["s"]
        holding = F.filter("spans", lambda x: (x["lo"] <= s) & (s < x["hi"]))
        # Two intervals: the larger offset is the earlier instant. None: the last interval that ended before.
        ended = F.filter("spans", lambda x: x["hi"] <= s)
        last = F.array_max(F.transform(ended, lambda x: F.struct(x["hi"], x["off"])))["off"]
        off = F.coalesce(at["off"], F.array_max(F.transform(holding, lambda x: x["off"])), last)
        return F.when(at["utc"], at["us"]).otherwise(at["us"] - off.cast("bigint") * 1_000_000)

    return joined.select(*(F.col("row")[c].alias(c) for c in df.columns if c != out), instant(F.col("at")).alias(out))


def recorded_instants(file_records: DataFrame, exif: DataFrame) -> DataFrame:
    """(file_id, origin, utc_us) of every date in file_records (current rows whose date_source isn't none) and exif
    that fixes an instant; repeated rows once. Rows without id are ignored."""
    current = (
        file_records.select(norm_id("id").alias("file_id"), "pipeline_stage", F.struct("date_value", "date_source", "timezone_offset").alias("r"))
        .where("file_id is not null")
        .groupBy("file_id")
        .agg(F.max_by("r", F.coalesce("pipeline_stage", F.lit(-1))).alias("r"))
    )
    records = current.where(F.coalesce(F.lower(F.trim("r.date_source")), F.lit("none")) != "none").select(
        "file_id", F.lit("record").alias("origin"), F.col("r.date_value").alias("text"), F.col("r.timezone_offset").alias("zone")
    )
    shots = exif.select(norm_id("file_id").alias("file_id"), F.lit("exif").alias("origin"), F.col("date_original").alias("text"), F.col("timezone_offset").alias("zone")).where("file_id is not null")
    shots = shots.where(F.col("text").isNotNull()).distinct()
    found = to_instants(records.unionByName(shots), "text", "zone").where("utc_us is not null")
    return found.select("file_id", "origin", "utc_us").distinct()
