"""Side effects: copies, deletions, exports. All may be repeated by a task that is run again."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024 * 1024


def copy_file(source: str, target: str) -> str | None:
    """Copies by way of a temporary file beside the target, which then takes its name; what went wrong, or None."""
    try:
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        handle, part = tempfile.mkstemp(dir=os.path.dirname(target) or ".", prefix=".part-")
        try:
            with os.fdopen(handle, "wb") as out, open(source, "rb") as f:
                shutil.copyfileobj(f, out, BLOCK)
            shutil.copystat(source, part)
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.unlink(part)
    except OSError as e:
        return str(e)
    return None


def copied(plan: DataFrame, source: str = "source_path", target: str = "destination_path") -> DataFrame:
    """plan's source and target with copied and error: runs the copies of rows with a target. An action runs them;
    write the result once, as each further action would copy again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = [copy_file(s, t) for s, t in zip(pdf[source], pdf[target])]
            yield pd.DataFrame({source: pdf[source], target: pdf[target], "copied": [e is None for e in errors], "error": errors})

    todo = plan.where(F.col(target).isNotNull() & F.col(source).isNotNull()).select(source, target)
    return todo.mapInPandas(run, f"{source} string, {target} string, copied boolean, error string")


def deleted(paths: DataFrame, path: str = "destination_path") -> DataFrame:
    """path, removed: deletes files; one that isn't there counts as removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for p in pdf[path]:
                try:
                    os.unlink(p)
                    done.append(True)
                except FileNotFoundError:
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({path: pdf[path], "removed": done})

    return paths.where(F.col(path).isNotNull()).select(path).mapInPandas(run, f"{path} string, removed boolean")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def compared(pairs: DataFrame, source: str = "source_path", target: str = "destination_path", quick: bool = True) -> DataFrame:
    """pairs' source and target with same and error: whether two files have equal contents. quick: files of different
    sizes aren't read. What can't be read is not the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in zip(pdf[source], pdf[target]):
                try:
                    differs = quick and os.path.getsize(a) != os.path.getsize(b)
                    out.append((not differs and file_digest(a) == file_digest(b), None))
                except OSError as e:
                    out.append((False, str(e)))
            yield pd.DataFrame({source: pdf[source], target: pdf[target], "same": [x[0] for x in out], "error": [x[1] for x in out]})

    return pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).mapInPandas(run, f"{source} string, {target} string, same boolean, error string")


class WriterLock:
    """One writer for a catalogue: a file that names its process; that of a process which has ended is taken over."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> WriterLock:
        for _ in range(2):
            try:
                with open(self.path, "x") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                if self._alive():
                    raise RuntimeError(f"{self.path} is held by another writer") from None
                os.unlink(self.path)
        raise RuntimeError(f"{self.path} can't be taken")

    def _alive(self) -> bool:
        try:
            with open(self.path) as f:
                os.kill(int(f.read()), 0)
        except (ValueError, ProcessLookupError, FileNotFoundError):
            return False
        except PermissionError:
            pass
        return True

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def remove_empty_parents(folders: list[str], stop: str) -> int:
    """Removes empty folders from these upwards, as far as `stop`; how many."""
    removed = 0
    for folder in sorted(set(folders), key=lambda f: -f.count(os.sep)):
        while folder.startswith(stop.rstrip(os.sep) + os.sep) and os.path.isdir(folder) and not os.listdir(folder):
            os.rmdir(folder)
            removed += 1
            folder = os.path.dirname(folder)
    return removed


def sink_plan(files: DataFrame) -> DataFrame:
    """Files to copy, with an export row more for each original and RAW image: (file_id, kind, destination_path)."""
    export = F.when(F.col("category").isin("Originals", "RAW"), F.struct(F.lit("export").alias("kind"), F.col("export_path").alias("destination_path")))
    rows = F.array_compact(F.array(F.struct(F.lit("file").alias("kind"), "destination_path"), export))
    return files.where("destination_path is not null").select("file_id", F.explode(rows).alias("x")).select("file_id", "x.*")


def log_line(n: Column, total: Column, action: Column, source: Column, target: Column) -> Column:
    """A line of a session's log: `[ 3/10] copy a -> b`."""
    return F.concat(F.lit("["), n.cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), action, F.lit(" "), source, F.coalesce(F.concat(F.lit(" -> "), target), F.lit("")))


def export(rows: DataFrame, path: str, kind: str = "csv", one_file: bool = False) -> None:
    """Writes a report as csv, json or text lines; one_file for reports that are known to be small."""
    rows = rows.coalesce(1) if one_file else rows
    w = rows.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "json": lambda: w.json(path), "text": lambda: w.text(path)}[kind]()


def summary_rows(preview: DataFrame, categories: DataFrame, reasons: DataFrame) -> DataFrame:
    """(section, key, value) of a preview, in the order of sections; breakdowns by count, then key."""
    head = preview.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in preview.columns)), F.array(*(F.col(c).cast("string") for c in preview.columns)))).alias("key", "value"))
    part = lambda df, n, name, key: df.select(F.lit(n).alias("n"), F.lit(name).alias("section"), F.col(key).alias("key"), F.col("files").cast("string").alias("value"), (-F.col("files")).alias("o"))
    first = head.select(F.lit(0).alias("n"), F.lit("summary").alias("section"), "key", "value", F.lit(0).cast("bigint").alias("o"))
    return first.unionByName(part(categories, 1, "category", "category")).unionByName(part(reasons, 2, "skip_reason", "reason")).orderBy("n", "o", "key").select("section", "key", "value")
