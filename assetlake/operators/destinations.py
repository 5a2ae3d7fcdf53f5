"""Destination paths without collisions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake import rules
from assetlake.functions.media import make_model_label
from assetlake.functions.paths import basename, extension, parent_dir, sanitize
from assetlake.runtime import cut, discard, ranked


def file_name(name: Column, ext: Column, date: Column, make: Column, model: Column, burst_index: Column | None = None) -> Column:
    """`YYYY-MM-DD HH-MM-SS[-NNN] -- Make - Model -- name.ext` of what is known."""
    when = F.date_format(date, "yyyy-MM-dd HH-mm-ss")
    if burst_index is not None:
        when = F.concat(when, F.coalesce(F.concat(F.lit("-"), F.lpad(burst_index.cast("string"), 3, "0")), F.lit("")))
    full = F.concat(F.concat_ws(" -- ", F.nullif(when, F.lit("")), F.nullif(make_model_label(make, model), F.lit("")), name), F.coalesce(ext, F.lit("")))
    return sanitize(full)


def category_folder(category: Column, date: Column, make: Column, model: Column) -> Column:
    """Folder of a category: with camera and year, with the year (0000 if unknown), or the category itself."""
    year = F.coalesce(F.date_format(date, "yyyy"), F.lit("0000"))
    return (
        F.when(category.isin(*rules.CAMERA_YEAR), F.concat_ws("/", category, F.nullif(make_model_label(make, model), F.lit("")), year))
        .when(category.isin(*rules.YEAR_ONLY), F.concat_ws("/", category, year))
        .when(category == "Originals/Unknown", F.concat_ws("/", category, year))
        .otherwise(category)
    )


def destination(root: str, file_type: Column, category: Column, name: Column, ext: Column, date: Column, make: Column, model: Column, burst_index: Column | None = None, export: bool = False) -> Column:
    """Full destination path. Originals keep their file name; an export goes to Exports/year."""
    media = rules.lookup(file_type, rules.MEDIA_FOLDERS)
    inner = F.when(file_type == "document", F.regexp_replace(category, "^Documents/", "")).otherwise(category)
    folder = F.concat(F.lit("Exports/"), F.coalesce(F.date_format(date, "yyyy"), F.lit("0000"))) if export else category_folder(inner, date, make, model)
    made = file_name(name, ext, date, make, model, burst_index)
    final = made if export else F.when(category == "Originals", sanitize(F.concat(name, F.coalesce(ext, F.lit(""))))).otherwise(made)
    return F.concat_ws("/", F.lit(root), media, folder, final)


def _numbered(name: str, n: int) -> str:
    k = name.rfind(".")
    return f"{name[:k]}-{n}{name[k:]}" if k > 0 and name[:k].strip(".") else f"{name}-{n}"


#: Families of colliding names of at most so many rows are settled name by name; larger ones by their numbers.
FAMILY_ROWS = 100_000


def _with_number(path: Column, n: Column) -> Column:
    ext = extension(path)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), F.lit("-"), n.cast("string"), ext)


def _parent(path: Column) -> tuple[Column, Column]:
    """The path that `path` is a numbered name of, and the number; null if it is none of any."""
    ext = extension(path)
    base = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    number = F.nullif(F.regexp_extract(base, r"-([1-9]\d{0,17})$", 1), F.lit(""))
    parent = F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(number) - 1), ext)
    known = _with_number(parent, number) == path
    return F.when(known, parent), F.when(known, number.cast("bigint"))


def _meet(batches):
    """path, number, place, used of each number that a row of its path comes to: used if it is gone by then, so that
    the row in this place goes on to the next one; else the row takes it.

    Sorted by path, then row i (at = i, kind 0, when = its time) and number k (at = k, kind 1, when = the time from
    which it is in use). The row that comes to k is the one in place k - (numbers used so far), so that only the times
    of as many rows wait here.
    """
    path, wait, head, skipped = None, deque(), 1, 0
    for pdf in batches:
        out = []
        for p, at, kind, when in zip(pdf["_path"], pdf["_at"], pdf["_kind"], pdf["_when"]):
            if p != path:
                path, head, skipped = p, 1, 0
                wait.clear()
            if kind == 0:
                wait.append(when)
            while wait and head < at - skipped:
                wait.popleft()
                head += 1
            if kind == 1 and wait:
                used = when < wait[0]
                out.append((p, at, head, used))
                skipped += used
        yield pd.DataFrame(out, columns=["_path", "_number", "_place", "_used"])


def _settle_large(rows: DataFrame, held: DataFrame, keys: list[str], path: str, order: str, out: str) -> DataFrame:
    """rows (of families by keys) with `out` as without_collisions() has it; held: _p, paths of the families that are taken.

    A numbered name can be wanted by rows of that very path or be given to a row of the path without the number. When
    the former come is known beforehand, so that the numbers of a path are settled once it is known whether its own
    name was given away: level by level of names with no number, one number and so on.
    """
    rows = cut(ranked(ranked(rows, keys, [order, path], "_t"), [path], ["_t"], "_i"), "large")
    parent, number = _parent(F.col("_path"))
    paths = rows.groupBy(F.col(path).alias("_path")).agg(F.min("_t").alias("_when"), F.count(F.lit(1)).alias("_rows"))
    chain = F.regexp_extract(basename(F.col("_path")), r"((-\d+)*)(\.[^.]*)?$", 1)
    paths = cut(paths.select("*", parent.alias("_parent"), number.alias("_number"), F.size(F.split(chain, "-")).alias("_level")), "paths")
    old = held.select(F.col("_p").alias("_path"), F.lit(0).cast("bigint").alias("_when"))
    blocked = paths.select("_parent", "_number", "_when").unionByName(old.select(parent.alias("_parent"), number.alias("_number"), "_when"))
    blocked = blocked.where("_parent is not null").groupBy(F.col("_parent").alias("_path"), "_number").agg(F.min("_when").alias("_when"))
    blocked = cut(blocked.join(paths.select("_path"), "_path", "left_semi"), "blocked")
    gone = cut(old.join(paths, "_path", "left_semi").select("_path"), "gone")
    contested = paths.join(blocked.select("_path").distinct(), "_path", "left_semi")
    used = None
    for level in sorted(r[0] for r in contested.select("_level").distinct().collect()):  # at most half a name's length
        mine = contested.where(F.col("_level") == level).join(gone.withColumn("_gone", F.lit(1)), "_path", "left")
        mine = cut(mine.withColumn("_gone", F.coalesce("_gone", F.lit(0))).where("_rows + _gone > 1").select("_path", "_gone"), "level")
        events = rows.join(mine, F.col(path) == F.col("_path")).select("_path", (F.col("_i") - 1 + F.col("_gone")).alias("_at"), F.lit(0).alias("_kind"), F.col("_t").alias("_when")).where("_at > 0")
        events = events.unionByName(blocked.join(mine, "_path", "left_semi").select("_path", F.col("_number").alias("_at"), F.lit(1).alias("_kind"), "_when"))
        met = cut(events.repartition("_path").sortWithinPartitions("_path", "_at", "_kind").mapInPandas(_meet, "_path string, _number bigint, _place bigint, _used boolean"), "met")
        given = met.where("not _used").select(_with_number(F.col("_path"), F.col("_number")).alias("_path"))
        last, gone = gone, cut(gone.unionByName(given).distinct(), "gone")
        discard(last)
        step = met.where("_used").select("_path", "_place", "_number")
        used = step if used is None else used.unionByName(step)
    placed = rows.join(gone.select(F.col("_path").alias(path), F.lit(1).alias("_gone")), path, "left").withColumn("_place", F.col("_i") - 1 + F.coalesce("_gone", F.lit(0)))
    placed = placed.drop("_t", "_i", "_gone").withColumns({"_used": F.lit(False), "_number": F.lit(0).cast("bigint")})
    numbered = placed.where("_place > 0")
    if used is not None:  # among its rows and the numbers that they go past, a row's place is its number
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema.fields if f.name not in (path, "_place", "_number", "_used")]
        numbered = numbered.unionByName(used.select(F.col("_path").alias(path), "_place", "_number", F.lit(True).alias("_used"), *blank))
    numbered = ranked(numbered.withColumn("_row", ~F.col("_used")), [path], ["_place", "_row", "_number"], "_n").where("_row")
    final = placed.where("_place = 0").withColumn(out, F.col(path))
    cols = final.columns
    return final.unionByName(numbered.withColumn(out, _with_number(F.col(path), F.col("_n"))).select(*cols))


def without_collisions(files: DataFrame, path: str, order: str, taken: DataFrame | None = None, out: str = "final_path") -> DataFrame:
    """files with `out`: the path itself for the first file in `order`, else with the smallest -1, -2, ... before its
    extension that is free. taken: paths (a column named as `path`) that exist already. Null paths stay null. `order`
    must tell rows of one path apart.

    A family is the names of a folder that differ by numbers at their ends only: what a numbered name may hit lies
    within. Families without a collision keep their names. In those where no name has a number and none is taken the
    n-th file gets the number n, ranked over all tasks. The others are settled name by name, each family in a task; one
    of more than FAMILY_ROWS rows is settled by numbers over all tasks, with the same names.
    """
    fam = lambda c: F.struct(parent_dir(F.col(c)).alias("d"), F.regexp_replace(basename(F.col(c)), r"(-\d+)+(\.[^.]*)?$", "$2").alias("s"))
    number = lambda c: F.greatest(F.coalesce(F.regexp_extract(basename(F.col(c)), r"-(\d{1,9})(?:\.[^.]*)?$", 1).try_cast("bigint"), F.lit(0)), F.lit(0))
    mine = files.withColumn("_d", fam(path)["d"]).withColumn("_s", fam(path)["s"])
    keys = ["_d", "_s"]
    held = (taken.select(F.col(path).alias("_p")).where("_p is not null").distinct() if taken is not None else files.sparkSession.createDataFrame([], "_p string")).withColumn("_d", fam("_p")["d"]).withColumn("_s", fam("_p")["s"])
    facts = mine.where(F.col(path).isNotNull()).groupBy(*keys).agg(F.count(path).alias("n"), F.min(path).alias("a"), F.max(path).alias("b"), F.max(number(path)).alias("top"), F.lit(0).alias("o"))
    facts = facts.unionByName(held.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.max(number("_p")).alias("top"), F.lit(1).alias("o")))
    facts = facts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("top").alias("top"), F.max("o").alias("o"))
    alone, plain = "(n <= 1 and o = 0)", "(a = b and top = 0 and o = 0)"
    way = F.expr(f"case when {alone} then 0 when {plain} then 1 when n > {FAMILY_ROWS} then 2 else 3 end")
    known = cut(mine.join(facts.where("n > 0").select(*keys, way.alias("_way"), "top"), keys, "left"), "families")
    cols = files.columns
    kept = known.where("_way is null or _way = 0").withColumn(out, F.col(path)).select(*cols, out)
    first = ranked(known.where("_way = 1"), keys, [order], "_n").withColumn(out, F.when(F.col("_n") == 1, F.col(path)).otherwise(_with_number(F.col(path), F.col("_n") - 1))).select(*cols, out)
    done = kept.unionByName(first)
    large = known.where("_way = 2")
    if not large.isEmpty():
        done = done.unionByName(_settle_large(large.select(*keys, *cols), held.join(large.select(*keys).distinct(), keys, "left_semi"), keys, path, order, out).select(*cols, out))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in files.schema.fields if f.name != path]
    busy = known.where("_way = 3")
    old = held.join(busy.select(*keys).distinct(), keys, "left_semi")
    rows = busy.select(*keys, *cols, F.lit(False).alias("_old")).unionByName(old.select(*keys, F.col("_p").alias(path), *blank, F.lit(True).alias("_old")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        used = set(pdf.loc[pdf["_old"], path])
        todo = pdf[~pdf["_old"]].sort_values([order, path], kind="stable")
        found, last = [], {}
        for p in todo[path]:
            folder, slash, name = p.rpartition("/")
            final = p
            while final in used:
                last[p] = last.get(p, 0) + 1
                final = folder + slash + _numbered(name, last[p])
            used.add(final)
            found.append(final)
        done = todo.drop(columns=["_old", *keys])
        done[out] = found
        return done

    schema = T.StructType([*files.schema.fields, T.StructField(out, T.StringType())])
    return done.unionByName(rows.groupBy(*keys).applyInPandas(settle, schema))
