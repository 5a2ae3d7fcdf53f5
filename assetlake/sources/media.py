"""Metadata from contents and from what metadata tools print. Decoders that need packages are left out if these are
not installed; the parsers here need none."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.functions.dates import tool_date
from assetlake.functions.media import exif_status, looks_like_encoder
from assetlake.functions.records import EXIF_STATUS, rank_in

MP4_EPOCH = 2082844800
_MP4 = T.StructType([
    T.StructField("duration_seconds", T.DoubleType()), T.StructField("created", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("make", T.StringType()), T.StructField("model", T.StringType()), T.StructField("duration_unknown", T.BooleanType()),
])


def atoms(data: bytes, start: int, end: int):
    """(type, from, to) of the atoms of a range: 32- and 64-bit sizes, size 0 to its end. Stops at what isn't one."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _mvhd(data: bytes, a: int) -> tuple[int, int, int]:
    if data[a] == 1:
        created, _, scale, length = struct.unpack_from(">QQIQ", data, a + 4)
    else:
        created, _, scale, length = struct.unpack_from(">IIII", data, a + 4)
    return created, scale, length


def parse_mp4(data: bytes | None) -> dict:
    """Duration, creation (seconds since 1970, null unless later), frame size and camera of an ISO media file."""
    out = {"duration_seconds": None, "created": None, "width": None, "height": None, "make": None, "model": None, "duration_unknown": True}
    try:
        for kind, a, b in atoms(data or b"", 0, len(data or b"")):
            if kind == b"moov":
                _moov(data, a, b, out)
    except (struct.error, IndexError):
        pass
    out["duration_unknown"] = out["duration_seconds"] is None
    return out


def _moov(data: bytes, a: int, b: int, out: dict) -> None:
    for kind, x, y in atoms(data, a, b):
        if kind == b"mvhd":
            created, scale, length = _mvhd(data, x)
            out["duration_seconds"] = round(length / scale, 3) if scale else None
            out["created"] = created - MP4_EPOCH if created > MP4_EPOCH else None
        elif kind == b"trak":
            for k, p, q in atoms(data, x, y):
                if k == b"tkhd" and q - p >= 84:
                    w, h = (v >> 16 for v in struct.unpack_from(">II", data, q - 8))
                    if w and h and not out["width"]:
                        out["width"], out["height"] = w, h
        elif kind == b"udta":
            for k, p, q in atoms(data, x, y):
                name = {b"\xa9mak": "make", b"\xa9mod": "model"}.get(k)
                if name and q - p > 4:
                    size = struct.unpack_from(">H", data, p)[0]
                    text = data[p + 4 : min(q, p + 4 + size)].decode("utf-8", "ignore").replace("\x00", "").strip()
                    out[name] = text or None


@F.pandas_udf(_MP4)
def mp4_metadata(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_mp4(None if c is None else bytes(c)) for c in content], columns=[f.name for f in _MP4.fields]).astype({"created": "Int64", "width": "Int32", "height": "Int32"})


def _said(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def _text(json: Column, *ways: str) -> Column:
    return _said(*(F.get_json_object(json, w) for w in ways))


# Keys of what a media prober and a metadata tool print.
MAKE_KEYS = ("make", "com.apple.quicktime.make", "com.android.manufacturer")
MODEL_KEYS = ("model", "com.apple.quicktime.model", "com.android.model")
LOCATION_KEYS = ("location", "com.apple.quicktime.location.ISO6709", "com.apple.quicktime.location")
PROBE_DATE_KEYS = ("creation_time", "date", "com.apple.quicktime.creationdate")
TOOL_DATE_KEYS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "TrackCreateDate")
PROBE = "format struct<duration:string, tags:map<string,string>>, streams array<struct<codec_type:string, width:string, height:string, tags:map<string,string>>>"


def _camera(make: Column, model: Column) -> tuple[Column, Column]:
    """Make and model, neither if one of them is the name of an encoder."""
    coded = looks_like_encoder(make) | looks_like_encoder(model)
    return F.when(~coded, make), F.when(~coded, model)


def probe_date(text: Column) -> Column:
    """timestamp_ntz in UTC of a prober's date: with T and Z, a fraction or none; with a blank; or a day alone."""
    forms = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", r"^\d{4}-\d{2}-\d{2}$")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "Z$", ""), "T", " ")
    return F.coalesce(*(F.when(text.rlike(shape), bare(text).try_cast("timestamp_ntz")) for shape in forms))


def probe_metadata(json: Column) -> Column:
    """struct of what a media prober prints as JSON: tags of the format, for the camera and the encoder then those of the
    first video stream; a camera whose name is that of an encoder is none."""
    doc = F.from_json(json, PROBE)
    video = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), 0)
    tag = lambda tags, *keys: _said(*(F.try_element_at(tags, F.lit(k)) for k in keys))
    top, own = doc["format"]["tags"], video["tags"]
    make, model = _camera(F.coalesce(tag(top, *MAKE_KEYS), tag(own, *MAKE_KEYS)), F.coalesce(tag(top, *MODEL_KEYS), tag(own, *MODEL_KEYS)))
    duration = doc["format"]["duration"].try_cast("double")
    return F.struct(
        F.round(duration, 3).alias("duration_seconds"), make.alias("make"), model.alias("model"), tag(top, *LOCATION_KEYS).isNotNull().alias("has_location"),
        probe_date(tag(top, *PROBE_DATE_KEYS)).alias("date"), F.coalesce(tag(top, "encoder"), tag(own, "encoder")).alias("encoder"), duration.isNull().alias("duration_unknown"),
        video["width"].try_cast("int").alias("width"), video["height"].try_cast("int").alias("height"),
    )


def tool_video(json: Column) -> Column:
    """struct of what a metadata tool prints as JSON for a video, as probe_metadata()."""
    first = lambda *names: _text(json, *(f"$.{n}" for n in names))
    make, model = _camera(first("Make"), first("Model"))
    duration = first("Duration").try_cast("double")
    w, h = first("ImageWidth").try_cast("int"), first("ImageHeight").try_cast("int")
    both = w.isNotNull() & h.isNotNull()
    return F.struct(
        F.round(duration, 3).alias("duration_seconds"), make.alias("make"), model.alias("model"), (first("GPSLatitude").isNotNull() | first("GPSLongitude").isNotNull()).alias("has_location"),
        F.coalesce(*(tool_date(first(n)) for n in TOOL_DATE_KEYS)).alias("date"), first("Software", "Encoder").alias("encoder"), duration.isNull().alias("duration_unknown"),
        F.when(both, w).alias("width"), F.when(both, h).alias("height"),
    )


def first_known(*tiers: Column) -> Column:
    """The first struct of video metadata that tells the duration, else the first that tells anything, else the last."""
    return F.coalesce(*(F.when(~t["duration_unknown"], t) for t in tiers), *(F.when(t["make"].isNotNull() | t["width"].isNotNull(), t) for t in tiers), tiers[-1])


def tool_metadata(json: Column) -> Column:
    """struct of what a metadata tool prints as JSON for an image, with exif_status."""
    first = lambda *names: _text(json, *(f"$.{n}" for n in names))
    number = lambda name, kind: F.get_json_object(json, f"$.{name}").try_cast(kind)
    make, model, software = first("Make"), first("Model"), first("Software")
    original, digitized, modified = (tool_date(first(n)) for n in ("DateTimeOriginal", "CreateDate", "ModifyDate"))
    lat, lon = number("GPSLatitude", "double"), number("GPSLongitude", "double")
    some = make.isNotNull() | model.isNotNull() | software.isNotNull() | original.isNotNull() | digitized.isNotNull() | modified.isNotNull() | lat.isNotNull()
    return F.struct(
        exif_status(original, make, model, some).alias("status"), make.alias("make"), model.alias("model"), software.alias("software"), original.alias("date_original"), digitized.alias("date_digitized"), modified.alias("date_modified"),
        lat.alias("gps_lat"), lon.alias("gps_lon"), number("Orientation", "int").alias("orientation"), number("ImageWidth", "int").alias("width"), number("ImageHeight", "int").alias("height"),
        first("OffsetTimeOriginal").alias("timezone_offset"),
    )


# Numbers of EXIF tags, and the bytes of the types of their values.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0112: "orientation", 0x0132: "modified", 0x9003: "original", 0x9004: "digitized", 0x9011: "offset", 0x0100: "width", 0x0101: "height", 0xA002: "width", 0xA003: "height"}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_EXIF = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("status", "make", "model", "software", "original", "digitized", "modified", "offset", "error")),
    *(T.StructField(n, T.DoubleType()) for n in ("gps_lat", "gps_lon")), *(T.StructField(n, T.IntegerType()) for n in ("orientation", "width", "height")),
])
EXIF_FIELDS = _EXIF.names


def _tiff(data: bytes) -> int:
    """Where the TIFF header of an image begins: at its start, or in the APP1 segment of a JPEG; -1 if there is none."""
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        return 0
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
            return at + 10
        at += 2 + size
    return -1


def _directory(data: bytes, base: int, at: int, order: str) -> dict:
    """Values of the entries of a directory: texts, numbers, and lists of numbers or of (numerator, denominator)."""
    out = {}
    for k in range(struct.unpack_from(order + "H", data, base + at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, base + at + 2 + 12 * k)
        size = TYPE_BYTES.get(kind, 0) * n
        if not 0 < size <= len(data):
            continue
        pos = base + at + 10 + 12 * k
        pos = base + struct.unpack_from(order + "I", data, pos)[0] if size > 4 else pos
        if kind in (2, 7):
            out[tag] = data[pos : pos + n].decode("utf-8", "replace").strip("\x00 ") or None
            continue
        values = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 5: "I", 9: "i", 10: "i"}[kind] * (n * (2 if kind in (5, 10) else 1)), data, pos)
        out[tag] = list(zip(values[::2], values[1::2])) if kind in (5, 10) else values[0] if n == 1 else list(values)
    return out


def _degrees(parts, ref) -> float | None:
    if not parts or not ref or len(parts) != 3:
        return None
    d, m, s = (n / d if d else 0.0 for n, d in parts)
    size = d + m / 60.0 + s / 3600.0
    return -size if ref.upper() in ("S", "W") else size


def parse_exif(data: bytes | None) -> dict:
    """EXIF of a JPEG or TIFF image (texts as they stand) with its status: ok with an original date and a camera,
    partial with anything, none, or error for what can't be read."""
    out = dict.fromkeys(EXIF_FIELDS)
    if not data:
        return out | {"status": "error", "error": "no content"}
    try:
        base = _tiff(data)
        if base >= 0:
            order = "<" if data[base : base + 2] == b"II" else ">"
            main = _directory(data, base, struct.unpack_from(order + "I", data, base + 4)[0], order)
            sub = _directory(data, base, main[EXIF_IFD], order) if isinstance(main.get(EXIF_IFD), int) else {}
            gps = _directory(data, base, main[GPS_IFD], order) if isinstance(main.get(GPS_IFD), int) else {}
            for tag, value in [*main.items(), *sub.items()]:
                if tag in EXIF_TAGS and isinstance(value, (str, int)):
                    out[EXIF_TAGS[tag]] = value
            out["gps_lat"], out["gps_lon"] = _degrees(gps.get(2), gps.get(1)), _degrees(gps.get(4), gps.get(3))
    except (struct.error, IndexError, KeyError) as e:
        return dict.fromkeys(EXIF_FIELDS) | {"status": "error", "error": str(e)}
    some = any(out[k] is not None for k in ("make", "model", "software", "original", "digitized", "modified", "gps_lat"))
    camera = out["make"] is not None or out["model"] is not None
    return out | {"status": "ok" if out["original"] is not None and camera else "partial" if some else "none"}


@F.pandas_udf(_EXIF)
def exif_metadata(content: pd.Series) -> pd.DataFrame:
    rows = [parse_exif(None if c is None else bytes(c)) for c in content]
    whole = lambda v: v if isinstance(v, int) else None
    text = lambda v: None if v is None else str(v)
    out = pd.DataFrame({k: [(whole if k in ("orientation", "width", "height") else (lambda v: v) if k.startswith("gps") else text)(r[k]) for r in rows] for k in EXIF_FIELDS})
    return out.astype({"orientation": "Int32", "width": "Int32", "height": "Int32", "gps_lat": "float64", "gps_lon": "float64"})


def best_exif(first: Column, second: Column) -> Column:
    """The first tier's struct, or the second's if its status ranks strictly better."""
    return F.when(first["status"].isNull() | (rank_in(second["status"], EXIF_STATUS) < rank_in(first["status"], EXIF_STATUS)), second).otherwise(first)


def _phash(pixels, width: int) -> str | None:
    """64-bit hash of grey values in rows of `width`: shrunk to 32 by 32 by means, the 8 by 8 lowest frequencies of its
    cosine transform, each against their median."""
    grey = np.asarray(pixels, dtype=np.float64)
    if not width or width < 1 or not len(grey) or len(grey) % width:
        return None
    grey = grey.reshape(-1, width)
    rows, cols = (np.minimum(np.arange(32) * n // 32, n - 1) for n in grey.shape)
    small = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), cols, axis=1) if min(grey.shape) >= 32 else grey[np.ix_(rows, cols)]
    if min(grey.shape) >= 32:
        small = small / np.outer(np.diff(np.append(rows, grey.shape[0])), np.diff(np.append(cols, grey.shape[1])))
    k = np.arange(32)
    wave = np.cos(np.pi * np.outer(np.arange(8), 2 * k + 1) / 64)
    low = wave @ small @ wave.T
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Perceptual hash of decoded grey images (array of values by row, and the width); null for no image."""
    return pd.Series([None if p is None or w is None or w != w else _phash(p, int(w)) for p, w in zip(pixels, width)], dtype=object)


def has_transparency(alpha: Column) -> Column:
    """Whether any value of an alpha channel is below 255."""
    return F.coalesce(F.array_min(alpha) < 255, F.lit(False))


#: Tag names by container and field.
TAG_KEYS = {
    "id3": {"title": "TIT2", "artist": "TPE1", "album": "TALB", "genre": "TCON", "year": "TDRC"},
    "vorbis": {"title": "title", "artist": "artist", "album": "album", "genre": "genre", "year": "date"},
    "mp4": {"title": "\xa9nam", "artist": "\xa9ART", "album": "\xa9alb", "genre": "\xa9gen", "year": "\xa9day"},
    "asf": {"title": "Title", "artist": "Author", "album": "WM/AlbumTitle", "genre": "WM/Genre", "year": "WM/Year"},
    "ape": {"title": "Title", "artist": "Artist", "album": "Album", "genre": "Genre", "year": "Year"},
}


def audio_tags(container: Column, tags: Column, stem: Column) -> Column:
    """struct of title, artist, album, genre, year, has_tags from a map of tags; the stem of the file stands in for a
    missing title, which doesn't count as a tag."""
    from assetlake.functions.media import year_tag

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for kind, keys in TAG_KEYS.items():
            out = F.when(container == kind, F.try_element_at(tags, F.lit(keys[name]))).otherwise(out)
        return F.nullif(F.trim(out), F.lit(""))

    title, artist, album, genre, year = field("title"), field("artist"), field("album"), field("genre"), year_tag(field("year"))
    some = title.isNotNull() | artist.isNotNull() | album.isNotNull()
    return F.struct(F.coalesce(title, stem).alias("title"), artist.alias("artist"), album.alias("album"), genre.alias("genre"), year.alias("year"), some.alias("has_tags"))


def enriched(audio, reference, on: list[str], fields: tuple[str, ...] = ("artist", "album", "genre", "year"), least_score: int = 80):
    """audio with nulls filled from a reference table (on, fields, score) where its score suffices; the best score of
    a key counts."""
    best = reference.where(F.col("score") >= least_score).groupBy(*on).agg(F.max_by(F.struct(*fields), F.struct("score", *fields)).alias("_ref"))
    j = audio.join(best, on, "left")
    return j.withColumns({f: F.coalesce(F.col(f), F.col(f"_ref.{f}")) for f in fields if f not in on}).select(*audio.columns)
