"""File trees as a Spark data source (format ``file_tree``).

Unlike ``binaryFile`` it lists directories, hidden names and empty directories, and it reports what
can't be read as rows instead of failing. The root is split into one input partition per top-level
subtree, so executors list subtrees in parallel; they must all see the root's path. A directory of very
many entries is dealt over several partitions by the names' checksums.

A row is an entry or an error::

    relative_path, size, last_write_time (100 ns ticks since 1601), attributes, file_id,
    is_directory, seq, error_code, error_message, lost_device

``seq`` is the order of arrival: the partition's number, then the order within it.
"""

from __future__ import annotations

import errno
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallystone.functions import text
from tallystone.operators.content import ticks

SCHEMA = "relative_path string, size long, last_write_time long, attributes long, file_id long, is_directory boolean, seq long, error_code long, error_message string, lost_device boolean"
ENTRY_COLUMNS = ("relative_path", "size", "last_write_time", "attributes", "file_id", "is_directory", "seq")
#: Subtrees below which a top-level directory with more entries than this is split once more.
SPLIT_ENTRIES = 1000
#: Entries of one directory that a task looks at, about, where the driver sees them: in the root, in its
#: directories, and in those that were split.
LIST_ENTRIES = 100_000
_SEQ = 1 << 40
#: System errors that stand for codes of ``text.DISCONNECT_CODES`` here.
_LOST = {errno.EIO: 1167, errno.ENODEV: 1167, errno.ENXIO: 1167, errno.ESTALE: 59, errno.ENOTCONN: 64, errno.EHOSTDOWN: 64, errno.ETIMEDOUT: 59}


class RootError(OSError):
    """The root is empty, not there, not readable or not a directory."""


def check_root(root: str) -> None:
    if not root:
        raise RootError("the root is empty")
    if not os.path.isdir(root):
        raise RootError(f"{root} isn't a directory" if os.path.exists(root) else f"{root} isn't there")
    try:
        os.scandir(root).close()
    except OSError as e:
        raise RootError(f"{root} can't be read: {e.strerror}") from e


def _entry(entry: os.DirEntry, rel: str) -> tuple:
    stat = entry.stat(follow_symlinks=False)
    is_dir = entry.is_dir(follow_symlinks=False) or entry.is_symlink() and entry.is_dir()
    return (rel, 0 if is_dir else stat.st_size, ticks(stat.st_mtime_ns), stat.st_mode, stat.st_ino, is_dir)


def _error(rel: str, e: OSError) -> tuple:
    code = text.ACCESS_DENIED_CODE if e.errno in (errno.EACCES, errno.EPERM) else _LOST.get(e.errno, e.errno or 0)
    return (rel, None, None, None, None, True, code, e.strerror or str(e), e.errno in _LOST)


def walk(root: str, top: str = "", deep: bool = True, separator: str = "/", part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Entries and errors below ``root``/``top``; links to directories are listed, not followed.
    ``deep=False`` lists that directory alone, and of it the ``part`` of ``parts`` that names fall into."""
    stack = [top]
    while stack:
        rel = stack.pop()
        try:
            with os.scandir(os.path.join(root, *rel.split(separator)) if rel else root) as it:
                for entry in it:
                    if parts > 1 and zlib.crc32(os.fsencode(entry.name)) % parts != part:
                        continue
                    path = f"{rel}{separator}{entry.name}" if rel else entry.name
                    try:
                        row = _entry(entry, path)
                    except FileNotFoundError:
                        continue  # it went meanwhile
                    except OSError as e:
                        yield _error(path, e)
                        continue
                    yield (*row, None, None, None)
                    if deep and entry.is_dir(follow_symlinks=False):
                        stack.append(path)
        except FileNotFoundError:
            continue
        except OSError as e:
            if part == 0:
                yield _error(rel, e)


@dataclass
class _Subtree(InputPartition):
    number: int
    top: str
    deep: bool
    part: int = 0
    parts: int = 1


class _Reader(DataSourceReader):
    def __init__(self, root: str, separator: str):
        self.root, self.separator = root, separator

    def partitions(self):
        check_root(self.root)
        found: list[_Subtree] = []

        def add(rel: str, level: int) -> None:
            full = os.path.join(self.root, *rel.split(self.separator)) if rel else self.root
            try:
                names, entries = [], 0
                with os.scandir(full) as it:
                    for e in it:
                        entries += 1
                        if e.is_dir(follow_symlinks=False):
                            names.append(e.name)
                parts = -(-entries // LIST_ENTRIES)
                wide = level == 0 or (len(names) > SPLIT_ENTRIES or parts > 1) and level < 3
            except OSError:
                names, wide = [], False
            if not wide:
                found.append(_Subtree(len(found), rel, True))
                return
            for part in range(max(1, parts)):
                found.append(_Subtree(len(found), rel, False, part, max(1, parts)))
            for name in sorted(names):
                add(f"{rel}{self.separator}{name}" if rel else name, level + 1)

        add("", 0)
        return found

    def read(self, partition):
        for i, row in enumerate(walk(self.root, partition.top, partition.deep, self.separator, partition.part, partition.parts)):
            yield (*row[:6], partition.number * _SEQ + i, *row[6:])


class FileTree(DataSource):
    """Options: ``path`` (the root) and ``separator`` (default ``/``)."""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options.get("path", ""), self.options.get("separator", "/"))


def scan(spark: SparkSession, root: str, separator: str = "/") -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of a tree. Each is a plan of its own: write the scan first if both, or later
    reads, must see one state (``plans.reconcile`` does)."""
    spark.dataSource.register(FileTree)
    return parts(spark.read.format("file_tree").option("separator", separator).load(root))


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries = rows.where(F.col("error_code").isNull()).select(*ENTRY_COLUMNS)
    errors = rows.where(F.col("error_code").isNotNull()).select(F.col("relative_path").alias("path"), F.col("error_message").alias("message"), F.col("error_code").alias("code"), "lost_device")
    return entries, errors
