"""Files that belong together: RAW and JPEG pairs, sidecars of videos, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake import rules
from assetlake.config import Config
from assetlake.functions.paths import basename, extension, parent_dir, stem
from assetlake.runtime import cut, ranked


def raw_jpeg_pairs(files: DataFrame, path: str = "source_path", folder: Column | None = None) -> DataFrame:
    """(raw_path, jpeg_path, stem): files of one folder and stem, whatever its case, of which exactly one is RAW and
    exactly one JPEG. folder: the scan root unless given. One aggregation; a key of many files is counted, not kept."""
    folder = folder if folder is not None else F.col("source_dir")
    ext = F.lower(extension(F.col(path)))
    raw, jpeg = ext.isin(*rules.dotted(rules.RAW)), ext.isin(*rules.dotted(rules.JPEG))
    g = files.where(raw | jpeg).groupBy(F.regexp_replace(folder, r"/+$", "").alias("_dir"), F.lower(stem(F.col(path))).alias("stem")).agg(
        F.count_if(raw).alias("_r"), F.count_if(jpeg).alias("_j"), F.max(F.when(raw, F.col(path))).alias("raw_path"), F.max(F.when(jpeg, F.col(path))).alias("jpeg_path")
    )
    return g.where("_r = 1 and _j = 1").select("raw_path", "jpeg_path", "stem")


def link_pairs(files: DataFrame, pairs: DataFrame, path: str = "source_path", member: str = "file_id") -> DataFrame:
    """files with pair_id, the id of the other file of its pair; a pair of which one is missing links nothing."""
    ids = files.select(F.col(path).alias("_p"), F.col(member).alias("_id"))
    both = pairs.join(ids.select(F.col("_p").alias("raw_path"), F.col("_id").alias("_raw")), "raw_path").join(ids.select(F.col("_p").alias("jpeg_path"), F.col("_id").alias("_jpeg")), "jpeg_path")
    links = both.select(F.col("_raw").alias(member), F.col("_jpeg").alias("pair_id")).unionByName(both.select(F.col("_jpeg").alias(member), F.col("_raw").alias("pair_id")))
    return files.drop("pair_id").join(links, member, "left")


def sidecars(files: DataFrame, path: str = "source_path", extensions: tuple[str, ...] = tuple(rules.dotted(rules.SIDECAR))) -> DataFrame:
    """(video_path, sidecar_path): sidecars in the folder of a video that have its stem, or whose name begins with its
    whole name, whatever their case and whatever follows (v.srt, v.mp4.srt, v.mp4_en.srt)."""
    p = F.col(path)
    d = files.select(p.alias("path"), parent_dir(p).alias("dir"), F.lower(basename(p)).alias("name"), F.lower(stem(p)).alias("stem"), F.lower(extension(p)).alias("ext"))
    videos = d.where(F.col("ext").isin(*rules.dotted(rules.VIDEO))).select(F.col("path").alias("video_path"), "dir", F.col("name").alias("video_name"), F.col("stem").alias("video_stem"))
    cars = d.where(F.col("ext").isin(*extensions)).select(F.col("path").alias("sidecar_path"), "dir", "name", "stem")
    # Each leading part of a sidecar's name that ends in the extension of a video may be a video's name, or be its stem: equi-joins.
    leading = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), F.lit(1), i))
    heads = cars.select("*", F.explode(F.filter(leading, lambda x: x.rlike(r"\.(" + "|".join(rules.VIDEO.split()) + r")\z"))).alias("head"))
    whole = heads.join(videos, (heads.dir == videos.dir) & (heads["head"] == videos.video_name)).select("video_path", "sidecar_path")
    same = cars.join(videos, (cars.dir == videos.dir) & (cars.stem == videos.video_stem)).select("video_path", "sidecar_path")
    return whole.unionByName(same).distinct()


def sidecar_copies(sidecars: DataFrame, destinations: DataFrame) -> DataFrame:
    """(video_path, sidecar_path, destination_path) of the sidecars of videos that are copied, each named after its
    video's new name: by the stem alone if it has the video's stem, else by the whole name and what followed it.
    destinations: video_path, destination_path of the videos; sidecars of others are left out."""
    j = sidecars.join(destinations.where("destination_path is not null").select("video_path", F.col("destination_path").alias("_to")), "video_path")
    video, car, to = F.col("video_path"), F.col("sidecar_path"), F.col("_to")
    base, own = F.lower(basename(video)), basename(car)
    extended = F.lower(own).startswith(base)
    cut_off = lambda x, ext: F.substring(x, F.lit(1), F.length(x) - F.length(ext))
    tail = F.substring(own, F.length(base) + 1, F.length(own))
    named = F.when(extended, F.concat(cut_off(to, extension(to)), extension(video), tail)).otherwise(F.concat(cut_off(to, extension(to)), extension(car)))
    return j.select("video_path", "sidecar_path", named.alias("destination_path"))


def burst_layer(files: DataFrame, keys: list[Column], least: int, layer: str, member: str = "file_id", name: str = "source_path") -> DataFrame:
    """(layer, burst_key, member, burst_index) of groups of at least `least` files with equal keys, nulls being equal.
    Members are numbered from 0 by lower-case name, then id."""
    key = F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))), {"ignoreNullFields": "false"})
    k = files.withColumn("burst_key", key)
    big = k.groupBy("burst_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("burst_key")
    rows = k.join(big, "burst_key").select("burst_key", member, F.lower(basename(F.col(name))).alias("_name"))
    return ranked(rows, ["burst_key"], ["_name", member], "_n").select(F.lit(layer).alias("layer"), "burst_key", member, (F.col("_n") - 1).alias("burst_index"))


def bursts(files: DataFrame, camera: Column, date: Column, flagged: Column, patterns: tuple[str, ...], member: str = "file_id", path: str = "source_path") -> DataFrame:
    """(layer, burst_key, member, burst_index): files that metadata calls a burst (of at least two in a second from a
    camera), else files whose names do (two with one prefix and camera), else three of a camera within a second. Each
    file belongs to one group."""
    named = files.select(F.col(member), F.col(path), camera.alias("_camera"), F.date_trunc("second", date).cast("timestamp_ntz").alias("_second"), flagged.alias("_flagged"), stem(F.col(path)).alias("_stem"))
    left = cut(named, "shots")
    camera, second, flagged, name = F.col("_camera"), F.col("_second"), F.col("_flagged"), F.col("_stem")
    prefix = F.coalesce(F.nullif(F.regexp_extract(name, Config().burst_keywords, 1), F.lit("")), name)
    out = None
    layers = (
        ("exif", flagged, [camera, second], 2),
        ("name", rules.any_glob(name, patterns), [F.lower(prefix), camera], 2),
        ("time", second.isNotNull(), [camera, second], 3),
    )
    for layer, use, keys, least in layers:
        found = burst_layer(left.where(use), keys, least, layer, member, path)
        left = left.join(found.select(member), member, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out
