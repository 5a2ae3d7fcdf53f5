"""Content type of files from their first bytes, else their extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import rules
from assetlake.functions.paths import MIME_OF, TYPE_OF, extension, file_type_of, mime_of


def content_type(path: Column, head: Column) -> Column:
    """struct(mime, file_type) of a file: RIFF containers, then ISO media boxes, then leading bytes (the longest
    first), then the extension. head: its first 32 bytes; null or empty means that it can't be read.

    An unknown brand is video/mp4; a video brand under an audio extension is audio.
    """
    pair = lambda mime, kind: F.struct(F.lit(mime).alias("mime"), F.lit(kind).alias("file_type"))
    hexed = F.hex(F.substring(head, 1, 32))
    code = lambda text: text.encode("latin-1").hex().upper()
    riff = F.when(hexed.startswith(code("RIFF")), rules.first_match([(F.substring(hexed, 17, 8) == code(k), pair(*v)) for k, v in rules.RIFF.items()]))
    brand = F.substring(hexed, 17, 8)
    known = rules.first_match([(brand.isin(*map(code, brands)), pair(*kind)) for kind, brands in rules.FTYP.items()], pair("video/mp4", "video"))
    boxed = F.when((F.substring(hexed, 9, 8) == code("ftyp")) & (F.length(hexed) >= 24), known)
    ext = F.lower(extension(path))
    audio_ext = rules.lookup(ext, TYPE_OF) == "audio"
    as_audio = F.struct(F.coalesce(rules.lookup(ext, MIME_OF), F.lit("audio/mp4")).alias("mime"), F.lit("audio").alias("file_type"))
    boxed = F.when((boxed["file_type"] == "video") & audio_ext, as_audio).otherwise(boxed)
    magic = rules.first_match([(hexed.startswith(k.hex().upper()), pair(*v)) for k, v in sorted(rules.MAGIC.items(), key=lambda kv: -len(kv[0]))])
    return F.coalesce(riff, boxed, magic, F.struct(mime_of(path).alias("mime"), file_type_of(path).alias("file_type")))


def is_iso_media(head: Column) -> Column:
    """Whether bytes 4 to 8 are `ftyp`."""
    return F.coalesce(F.hex(F.substring(head, 5, 4)) == "66747970", F.lit(False))
