"""A directory tree as a data source: every name, hidden ones and empty directories too.

``binaryFile`` skips names that start with a dot or an underscore and knows
no directories, so what it lists must not drive deletions. This source lists
completely. The driver only finds directories, level by level, until there
are enough to share out; a partition then lists its group of directories, the
lowest ones with everything below. A directory that can't be read counts as
empty. A link to a directory is listed, but not entered.

Local (mounted) folders are read with ``os.scandir``; other schemes go through
``pyarrow.fs``, whose file systems need no further package.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "sylva_listing"
SCHEMA = "path string, is_dir boolean, size bigint, mtime timestamp"
ARROW = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))])
ROWS = 50_000  # rows of a batch


def open_location(location: str) -> tuple[fs.FileSystem, str]:
    if "://" not in location and not location.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(location)
    return fs.FileSystem.from_uri(location)


def _entries(system: fs.FileSystem, directory: str) -> Iterator[tuple[str, bool, bool, int, int | None]]:
    """(path, is a directory, may be entered, size, mtime in microseconds) of a directory's own entries."""
    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(directory) as found:
                for e in found:
                    try:
                        st, is_dir = e.stat(), e.is_dir()
                        yield e.path, is_dir, e.is_dir(follow_symlinks=False), 0 if is_dir else st.st_size, st.st_mtime_ns // 1000
                    except OSError:  # a link that leads nowhere
                        yield e.path, False, False, 0, None
        except OSError:
            return
    else:
        try:
            found = system.get_file_info(fs.FileSelector(directory, recursive=False))
        except OSError:
            return
        for e in found:
            is_dir = e.type == fs.FileType.Directory
            yield e.path, is_dir, is_dir, 0 if is_dir else e.size or 0, None if e.mtime_ns is None else e.mtime_ns // 1000


@dataclass
class Group(InputPartition):
    """``own``: directories whose entries alone are listed; ``deep``: with everything below."""

    own: list[str]
    deep: list[str]


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.location = options["path"]
        self.groups = int(options.get("groups", "64"))

    def partitions(self) -> list[Group]:
        """Level by level from the root, until there are several directories for each group."""
        system, root = open_location(self.location)
        own, front = [], [root]
        while front and len(front) < 4 * self.groups:
            own += front
            front = [path for d in front for path, _, enter, _, _ in _entries(system, d) if enter]
        n = max(1, min(self.groups, len(own) + len(front)))
        return [Group(own[k::n], front[k::n]) for k in range(n)]

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        system, _ = open_location(self.location)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW.types)], schema=ARROW)

        stack = [(d, False) for d in group.own] + [(d, True) for d in group.deep]
        while stack:
            d, deep = stack.pop()
            for path, is_dir, enter, size, mtime in _entries(system, d):
                rows.append((path, is_dir, size, mtime))
                if deep and enter:
                    stack.append((path, True))
                if len(rows) >= ROWS:
                    yield batch()
                    rows.clear()
        yield batch()


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def read_listing(spark: SparkSession, location: str, groups: int | None = None) -> DataFrame:
    """``path, is_dir, size, mtime`` of everything below ``location`` (which is not listed itself)."""
    spark.dataSource.register(Listing)
    n = groups or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(NAME).option("groups", str(n)).load(location)
