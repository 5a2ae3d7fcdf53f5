"""Categories of files by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake import rules
from assetlake.config import Config
from assetlake.functions.media import display_ratio, screenshot_size
from assetlake.functions.paths import basename, extension, suffix


def image_category(path: Column, software: Column, make: Column, has_gps: Column, w: Column, h: Column, has_date: Column, config: Config = Config()) -> Column:
    name, ext = basename(path), F.lower(suffix(path))
    said = lambda patterns: F.coalesce(software.rlike("|".join(patterns)), F.lit(False)) if patterns else F.lit(False)
    bare = make.isNull() & ~F.coalesce(has_gps, F.lit(False))
    return rules.first_match([
        (ext.isin(*rules.dotted(rules.RAW)), "RAW"),
        (said(config.editor_patterns) & ~said(config.editor_exclusions), "Edited"),
        (rules.any_glob(name, config.screenshot_filename_patterns), "Screenshots"),
        (rules.any_glob(name, config.social_media_image_patterns), "Social Media"),
        (bare & screenshot_size(w, h, config.screenshot_resolutions, config.screenshot_tolerance), "Screenshots"),
        (bare & display_ratio(w, h), "Screenshots"),
        (ext.isin(*config.sidecar_extensions), "Hidden"),
        (make.isNotNull(), "Originals"),
        (F.coalesce(has_date, F.lit(False)), "Export"),
    ], "Collection")


def video_category(path: Column, duration: Column, unknown: Column, make: Column, model: Column, has_location: Column, config: Config = Config()) -> Column:
    name, ext = basename(path), F.lower(suffix(path))
    known = F.when(~F.coalesce(unknown, F.lit(False)), duration)
    return rules.first_match([
        ((known < 10) & rules.any_glob(name, config.motion_photo_patterns), "Motion Photos"),
        (rules.any_glob(name, config.social_media_video_patterns), "Social Media"),
        (make.isNotNull() | model.isNotNull(), "Camera"),
        (F.coalesce(has_location, F.lit(False)) | ext.isin(".3gp", ".3g2"), "Mobile"),
        (ext.isin(".mts", ".m2ts", ".mod", ".tod", ".mxf"), "Camcorder"),
        (known > 900, "Movies"),
    ], "Clips")


def audio_category(path: Column, has_tags: Column, config: Config = Config()) -> Column:
    name, ext = basename(path), F.lower(suffix(path))
    return rules.first_match([
        (ext.isin(".m4a", ".aac", ".amr") & rules.any_glob(name, config.voice_note_patterns), "Voice Notes"),
        (ext.isin(".opus", ".ogg") & rules.any_glob(name, ("PTT-*-WA*",)), "WhatsApp"),
        (rules.any_glob(name, config.call_recording_patterns), "Call Recordings"),
        (F.coalesce(has_tags, F.lit(False)), "Songs"),
        (ext.isin(*rules.dotted(rules.MUSIC)), "Songs"),
    ], "Collection")


def document_category(path: Column) -> Column:
    ext = F.lower(suffix(path))
    return rules.first_match([(ext.isin(*rules.dotted(v)), f"Documents/{k}") for k, v in rules.DOCUMENT_FOLDERS.items()], "Documents/Others")


def category(file_type: Column, image: Column, video: Column, audio: Column, document: Column) -> Column:
    """The category of a file of any type; sidecars and unknown files are `Other`."""
    return rules.first_match([(file_type == "image", image), (file_type == "video", video), (file_type == "audio", audio), (file_type == "document", document)], "Other")


__all__ = ["audio_category", "category", "document_category", "extension", "image_category", "video_category"]
