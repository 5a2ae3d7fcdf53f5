"""Fixed tables of the catalogue, and compilers from rule lists to Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by file type.
IMAGE = """jpg jpeg png gif bmp tiff tif webp heic heif avif jxl ico svg psd ai eps indd"""
RAW = """raw cr2 cr3 nef nrw arw srf sr2 dng orf erf raf rw2 rwl pef ptx srw x3f 3fr mef mos mrw kdc dcr iiq gpr"""
VIDEO = """mp4 mov avi mkv wmv flv webm m4v mpg mpeg 3gp 3g2 mts m2ts ts vob ogv divx asf rm rmvb f4v"""
AUDIO = """mp3 wav flac aac ogg wma m4a opus aiff aif alac ape mid midi amr ac3 dts pcm caf mka"""
DOCUMENT = """pdf doc docx xls xlsx ppt pptx odt ods odp txt rtf csv tsv md html htm xml json yaml yml tex log epub mobi"""
SIDECAR = """thm srt sub lrc xmp aae"""
JPEG = "jpg jpeg"
MUSIC = "mp3 flac wma aiff aif ape alac wav"
TYPE_EXTENSIONS = {"image": f"{IMAGE} {RAW}", "video": VIDEO, "audio": AUDIO, "document": DOCUMENT, "sidecar": SIDECAR}

# MIME types by extension.
MIME = {
    "image/jpeg": "jpg jpeg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff tif", "image/webp": "webp",
    "image/heic": "heic", "image/heif": "heif", "image/avif": "avif", "image/jxl": "jxl", "image/svg+xml": "svg", "image/x-icon": "ico",
    "image/vnd.adobe.photoshop": "psd", "image/x-canon-cr2": "cr2", "image/x-canon-cr3": "cr3", "image/x-nikon-nef": "nef",
    "image/x-sony-arw": "arw", "image/x-adobe-dng": "dng", "image/x-olympus-orf": "orf", "image/x-fuji-raf": "raf",
    "image/x-panasonic-rw2": "rw2", "image/x-pentax-pef": "pef", "image/x-samsung-srw": "srw",
    "video/mp4": "mp4", "video/quicktime": "mov", "video/x-msvideo": "avi", "video/x-matroska": "mkv", "video/webm": "webm",
    "video/x-ms-wmv": "wmv", "video/x-flv": "flv", "video/x-m4v": "m4v", "video/mpeg": "mpg mpeg", "video/3gpp": "3gp", "video/mp2t": "mts",
    "audio/mpeg": "mp3", "audio/wav": "wav", "audio/flac": "flac", "audio/aac": "aac", "audio/ogg": "ogg", "audio/x-ms-wma": "wma",
    "audio/mp4": "m4a", "audio/opus": "opus", "audio/aiff": "aiff aif",
    "application/pdf": "pdf", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/plain": "txt", "text/csv": "csv",
    "text/markdown": "md", "text/html": "html htm", "application/xml": "xml aae", "application/json": "json",
    "application/rdf+xml": "xmp", "application/x-subrip": "srt",
}

# Major brands of ISO media files, by MIME and file type.
FTYP = {
    ("video/mp4", "video"): ["isom", "iso2", "mp41", "mp42"], ("video/x-m4v", "video"): ["M4V "], ("audio/mp4", "audio"): ["M4A ", "M4B ", "mp4a"],
    ("video/quicktime", "video"): ["qt  "], ("video/3gpp", "video"): ["3gp4", "3gp5", "3gp6"], ("image/heic", "image"): ["heic", "heix", "hevc"],
    ("image/heif", "image"): ["mif1"], ("image/heif-sequence", "image"): ["msf1"], ("image/avif", "image"): ["avif"], ("image/avif-sequence", "image"): ["avis"],
}
# Leading bytes by MIME and file type, and the four letters of RIFF containers.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", "image"), b"GIF87a": ("image/gif", "image"), b"GIF89a": ("image/gif", "image"),
    b"II*\x00": ("image/tiff", "image"), b"MM\x00*": ("image/tiff", "image"), b"\x1aE\xdf\xa3": ("video/x-matroska", "video"),
    b"fLaC": ("audio/flac", "audio"), b"OggS": ("audio/ogg", "audio"), b"%PDF": ("application/pdf", "document"),
    b"PK\x03\x04": ("application/zip", "document"), b"\xff\xd8\xff": ("image/jpeg", "image"), b"ID3": ("audio/mpeg", "audio"),
    b"BM": ("image/bmp", "image"), b"\xff\xfb": ("audio/mpeg", "audio"), b"\xff\xf3": ("audio/mpeg", "audio"), b"\xff\xf2": ("audio/mpeg", "audio"),
}
RIFF = {"WEBP": ("image/webp", "image"), "AVI ": ("video/x-msvideo", "video"), "WAVE": ("audio/wav", "audio")}

# Names that scans leave out.
HIDDEN_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".svn", ".hg")
CLOUD_STUBS = {"icloud": [".icloud"], "onedrive": [".cloud", ".odopen"], "dropbox": [".dropbox", ".dropbox.attr"]}
CLOUD_EMPTY_STUBS = {"gdrive": [".gdoc", ".gsheet", ".gslides"]}

# Folders of file types, and the shape of the path of a category.
MEDIA_FOLDERS = {"image": "Images", "video": "Videos", "audio": "Audio", "document": "Documents"}
CAMERA_YEAR = ("Originals", "RAW", "Camera")
YEAR_ONLY = ("Edited", "Export", "Motion Photos", "Voice Notes", "WhatsApp", "Call Recordings", "Mobile", "Camcorder", "Clips")
DISPLAY_RATIOS = ((16, 9), (4, 3), (18, 39))
DOCUMENT_FOLDERS = {
    "PDF": "pdf", "Text": "txt md rtf", "Word": "doc docx", "Excel": "xls xlsx", "PowerPoint": "ppt pptx",
    "Code": "py js ts tsx jsx java c cpp h hpp cs go rs rb php kt swift scala r m sh bash ps1 html htm css xml json yaml yml sql lua pl pm",
}
SOCIAL_PREFIXES = ("IMG-", "VID-", "FB_IMG_", "FB_VID_", "Screenshot_", "signal-", "Telegram")
ENCODER_WORDS = ("lavf", "lavc", "ffmpeg", "handbrake", "x264", "x265", "libx264", "libx265", "mencoder", "nero", "divx", "xvid", "libxvid")


def dotted(names: str) -> list[str]:
    """Extensions of a list, with their dot."""
    return ["." + n for n in names.split()]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a literal map, null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that Java and RE2 read alike: case-sensitive, * and ? match
    any character, also a newline; [seq] and [!seq] are classes, an unclosed bracket is itself."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        end = pattern.find("]", k + 1 + (pattern[k : k + 1] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            k = end + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_ -" else c)
    return "(?s)^(?:" + "".join(out) + r")\z"


def any_glob(c: Column, patterns: Iterable[str]) -> Column:
    """Whether a name matches any of the patterns; false for null."""
    hits = [c.rlike(glob_to_regex(p)) for p in patterns]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(False))


def first_match(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """CASE WHEN of ordered (condition, value) rules."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for condition, value in rules:
        out = F.when(condition, lit(value)) if out is None else out.when(condition, lit(value))
    return out if otherwise is None else out.otherwise(lit(otherwise))
