"""A directory listing as a Spark data source: every entry with the facts that scans decide by.

Unlike the built-in file sources it also lists names that begin with `_` or `.`, and it reads contents only to hash
them, in chunks. Each root, and each folder directly below it, is a task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_path string, source_dir string, file_size bigint, mtime double, dev bigint, inode bigint, is_symlink boolean, head binary, sha256_hash string, error string"
CHUNK, HEAD = 8 * 1024 * 1024, 32


@dataclass
class Branch(InputPartition):
    root: str
    folder: str
    deep: bool


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(r) for r in options.get("roots", options.get("path", "")).split(os.pathsep) if r]
        self.hashes = options.get("hash", "false").lower() == "true"
        self.follow = options.get("followsymlinks", options.get("followSymlinks", "false")).lower() == "true"
        self.skip = set(filter(None, options.get("skipdirs", options.get("skipDirs", "")).split(",")))

    def partitions(self) -> list[Branch]:
        out = []
        for root in self.roots:
            out.append(Branch(root, root, False))
            try:
                with os.scandir(root) as it:
                    out += [Branch(root, e.path, True) for e in sorted(it, key=lambda e: e.name) if e.is_dir(follow_symlinks=self.follow) and self._enter(e.name)]
            except OSError:
                continue
        return out

    def _enter(self, name: str) -> bool:
        return name not in self.skip and not (self.skip and name.startswith("."))

    def read(self, partition: Branch) -> Iterator[tuple]:
        seen: set[tuple[int, int]] = set()
        stack = [partition.folder]
        while stack:
            folder = stack.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:  # a folder that can't be read leaves a row that says so
                yield (folder, partition.root, None, None, None, None, False, None, None, str(e))
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=self.follow):
                        st = e.stat(follow_symlinks=self.follow)
                        if partition.deep and self._enter(e.name) and (st.st_dev, st.st_ino) not in seen:
                            seen.add((st.st_dev, st.st_ino))
                            stack.append(e.path)
                        continue
                    yield self._file(e, partition.root)
                except OSError as x:
                    yield (e.path, partition.root, None, None, None, None, e.is_symlink(), None, None, str(x))

    def _file(self, e: os.DirEntry, root: str) -> tuple:
        st = e.stat(follow_symlinks=self.follow)
        head = sha = error = None
        if e.is_file(follow_symlinks=self.follow):
            try:
                with open(e.path, "rb") as f:
                    head = f.read(HEAD)
                    if self.hashes:
                        digest = hashlib.sha256(head)
                        while block := f.read(CHUNK):
                            digest.update(block)
                        sha = digest.hexdigest()
            except OSError as x:
                error = str(x)
        return (e.path, root, st.st_size, st.st_mtime, st.st_dev, st.st_ino, e.is_symlink(), head, sha, error)


class Listing(DataSource):
    """spark.read.format("listing").option("roots", "a:b").option("hash", "true").load()"""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format `listing` known to a session."""
    spark.dataSource.register(Listing)
