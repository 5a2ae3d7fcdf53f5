"""Zone-offset intervals of the public tz database, exploded by year for an as-of join."""

from __future__ import annotations

import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
HOUR = 3600
FIRST_YEAR, LAST_YEAR = 1900, 2128
#: The last years of the table have each weekday of January 1, with and without a leap day: later years go by them.
CYCLE = 28


@lru_cache(maxsize=2)
def intervals(names: tuple[str, ...] | None = None) -> list[tuple[str, int, list[tuple[int, int, int]]]]:
    """(zone key, year, [(local_from_s, local_to_s, offset_s)]) of all zones, or of those named.

    Local seconds count from 1970 on the wall clock. An interval is listed in each year it touches, with two days
    to either side, the first year has all before it too; zone keys are lower case. The result is bounded by the tz database: about 600 zones by 200 years.
    """
    out = []
    for name in sorted(names if names is not None else available_timezones()):
        out += [(name.lower(), year, spans) for year, spans in _by_year(_changes(name))]
    return out


def _offset(zone: ZoneInfo, at: int) -> int:
    return int((EPOCH + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())


def _file(name: str) -> bytes:
    for folder in zoneinfo.TZPATH:
        path = Path(folder, name)
        if path.is_file():
            return path.read_bytes()
    return resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()


def _changes(name: str) -> list[tuple[int, int]]:
    """(utc second, offset from then on): those of the zone's TZif file (RFC 8536), then those of its rule for later
    years, found by halving two-week steps in which the offset differs."""
    data = _file(name)
    head = struct.Struct(">4sc15x6l")
    _, _, isut, isstd, leap, times, types, chars = head.unpack_from(data)
    start = head.size + times * 5 + types * 6 + chars + leap * 8 + isstd + isut  # the block of 64-bit times
    _, _, isut, isstd, leap, times, types, chars = head.unpack_from(data, start)
    at = start + head.size
    when = struct.unpack_from(f">{times}q", data, at)
    kind = struct.unpack_from(f">{times}B", data, at + times * 8)
    offsets = [struct.unpack_from(">l", data, at + times * 9 + 6 * k)[0] for k in range(types)]
    out = [(-(10**12), offsets[0]), *((t, offsets[k]) for t, k in zip(when, kind))]
    if b"," in data[at:].rsplit(b"\n", 2)[-2]:  # a rule with daylight saving
        zone, before = ZoneInfo(name), out[-1][1]
        lo = max(out[-1][0] + 1, int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds()))
        hi = int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds())
        for a in range(lo, hi, 14 * 24 * HOUR):
            b = min(a + 14 * 24 * HOUR, hi)
            if _offset(zone, b) != before:
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if _offset(zone, mid) == before else (a, mid)
                before = _offset(zone, b)
                out.append((b, before))
    return [x for k, x in enumerate(out) if not k or x[1] != out[k - 1][1]]


def _by_year(changes: list[tuple[int, int]]):
    ends = [c[0] for c in changes[1:]] + [10**12]
    spans = [(at + off, end + off, off) for (at, off), end in zip(changes, ends)]
    day = 24 * HOUR
    first = 0
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        lo = int((datetime(year, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds()) - 2 * day
        hi = int((datetime(year + 1, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds()) + 2 * day
        while spans[first][1] <= lo:
            first += 1
        k = first
        while k < len(spans) and spans[k][0] < hi:
            k += 1
        yield year, spans[0 if year == FIRST_YEAR else first : k]


def interval_table(spark: SparkSession) -> DataFrame:
    """zone_key, year, spans of intervals() as a table, made on the executors."""

    def made(batches):
        for pdf in batches:
            rows = intervals(tuple(pdf["name"]))
            yield pd.DataFrame({"zone_key": [r[0] for r in rows], "year": [r[1] for r in rows], "spans": [[{"lo": a, "hi": b, "off": c} for a, b, c in r[2]] for r in rows]})

    names = spark.createDataFrame(pd.DataFrame({"name": sorted(zone_names().values())})).repartition(4)
    return names.mapInPandas(made, "zone_key string, year int, spans array<struct<lo:bigint,hi:bigint,off:int>>")


@lru_cache(maxsize=1)
def zone_names() -> dict[str, str]:
    """Lower-case zone key to name."""
    return {n.lower(): n for n in available_timezones()}
