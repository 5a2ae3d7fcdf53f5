"""Paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import rules

TYPE_OF = {e: t for t, names in rules.TYPE_EXTENSIONS.items() for e in rules.dotted(names)}
MIME_OF = {e: m for m, names in rules.MIME.items() for e in rules.dotted(names)}
_EXT = r"(?s)^\.*[^.].*(\.[^.]*)$"


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """What precedes the last slash; '' without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def parent_name(path: Column) -> Column:
    return basename(parent_dir(path))


def extension(path: Column) -> Column:
    """Extension with its dot; leading dots of a name begin none, and `a.` has the extension `.`."""
    return F.regexp_extract(basename(path), _EXT, 1)


def suffix(path: Column) -> Column:
    """As extension, but a trailing dot is none."""
    return F.regexp_replace(extension(path), r"^\.$", "")


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def file_type_of(path: Column) -> Column:
    return F.coalesce(rules.lookup(F.lower(extension(path)), TYPE_OF), F.lit("unknown"))


def mime_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    return F.when(rules.lookup(ext, TYPE_OF).isNotNull(), F.coalesce(rules.lookup(ext, MIME_OF), F.lit("application/octet-stream"))).otherwise("application/octet-stream")


def is_hidden_or_system(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return name.startswith(".") | name.isin(*rules.HIDDEN_NAMES)


def in_skip_dir(path: Column) -> Column:
    """Whether a folder of the path is one that scans skip, or hidden."""
    dirs = F.split(parent_dir(path), "/")
    return F.exists(dirs, lambda d: d.isin(*rules.SKIP_DIRS) | d.startswith("."))


def is_temp_or_cache(path: Column) -> Column:
    ext = F.lower(extension(path))
    return ext.isin(".tmp", ".temp") | ext.startswith(".thumb")


def cloud_stub(path: Column, size: Column) -> Column:
    """The service whose placeholder a file is, null if it is none."""
    ends = lambda names, c: F.coalesce(*[F.when(c.endswith(n), F.lit(True)) for n in names], F.lit(False))
    known = [(ends(v, path), k) for k, v in rules.CLOUD_STUBS.items()]
    known += [(F.lower(extension(path)).isin(*v) & (size == 0), k) for k, v in rules.CLOUD_EMPTY_STUBS.items()]
    return rules.first_match(known)


def reject_reason(path: Column, size: Column) -> Column:
    """Why a scan leaves a file out, in the order of the rules; null if it is kept."""
    return rules.first_match([
        (in_skip_dir(path), "skip_dir"), (is_hidden_or_system(path), "hidden_or_system"), (is_temp_or_cache(path), "temp_or_cache"),
        (cloud_stub(path, size).isNotNull(), F.concat(F.lit("cloud_stub:"), cloud_stub(path, size))),
    ])


def skip_pattern(path: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern that skips a file, in list order; null if none does."""
    name = basename(path)
    return F.coalesce(*(F.when(name.rlike(rules.glob_to_regex(p)), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def sanitize(name: Column, windows: bool = True) -> Column:
    """A name without characters that the system forbids: blanks at the ends, then dots at the ends go, and an empty
    name becomes `unnamed`."""
    bad = r'[\\/:*?"<>|]' if windows else r"[/\x00]"
    t = F.regexp_replace(F.regexp_replace(name, bad, "_"), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^\.+|\.+$", ""), F.lit("")), F.when(name.isNotNull(), F.lit("unnamed")))


def swap_extension(path: Column, ext: str) -> Column:
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(extension(path))), F.lit(ext))
