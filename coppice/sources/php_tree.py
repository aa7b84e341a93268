"""The ``php_tree`` data source: a directory of source files as rows.

    spark.dataSource.register(PhpTree)
    spark.read.format("php_tree").option("extensions", ".php,.inc").load(root)

Files come with their number in byte order of the relative path; with option
``table`` set to ``excluded`` the rows are the excluded directories instead.
The walk lists names only; contents are read in the tasks, which share out the
files by size.  Equality and a prefix of ``path`` are taken over by the reader
(where the session allows it, see coppice.session), so files whose path does not
match keep their number but are not opened.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, StringStartsWith

from coppice.operators.scan import EXCLUDED, EXTENSIONS

PARTITION_BYTES = 16 << 20
FILES, HIDDEN = "file_ord long, path string, content binary", "dir string, files bigint"


class TreeError(Exception):
    """The tree can't be read or its analysis can't be written."""


def normal_extensions(given: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """A dot is put in front where it is missing; case is left as it is."""
    names = [e for e in given.split(",") if e] if isinstance(given, str) else given
    return tuple(e if e.startswith(".") else f".{e}" for e in names)


def walk(root: str, extensions: tuple[str, ...], exclude: tuple[str, ...]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(path, size) of every file and (dir, files) of every excluded directory, both in byte order.

    Links are not followed and linked files are left out; below an excluded
    directory every name with a wanted extension counts.  Unreadable
    directories are logged and left out.
    """
    files, hidden = [], []
    failed = lambda e: logging.getLogger(__name__).warning("cannot list %s: %s", e.filename, e.strerror)
    wanted = lambda name: name.lower().endswith(extensions)
    relative = lambda *parts: os.path.relpath(os.path.join(*parts), root).replace(os.sep, "/")
    for folder, dirs, names in os.walk(root, onerror=failed):
        for d in [d for d in dirs if d in exclude]:
            dirs.remove(d)
            n = sum(wanted(x) for _, _, below in os.walk(os.path.join(folder, d), onerror=failed) for x in below)
            if n:
                hidden.append((relative(folder, d), n))
        for name in filter(wanted, names):
            info = os.lstat(os.path.join(folder, name))
            if stat.S_ISREG(info.st_mode):
                files.append((relative(folder, name), info.st_size))
    in_bytes = lambda pair: os.fsencode(pair[0])
    return sorted(files, key=in_bytes), sorted(hidden, key=in_bytes)


class Pack(InputPartition):
    """Files a task reads: (number, path)."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class Hidden(InputPartition):
    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        self.extensions = normal_extensions(options.get("extensions", ",".join(EXTENSIONS)))
        self.exclude = tuple(d for d in options.get("exclude", ",".join(EXCLUDED)).split(",") if d)
        self.table, self.size = options.get("table", "files"), int(options.get("partitionBytes", PARTITION_BYTES))
        self.equal: list[str] = []
        self.begins: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what is asked of the path alone."""
        for f in filters:
            if self.table != "files" or getattr(f, "attribute", None) != ("path",) or not isinstance(f, EqualTo | StringStartsWith | IsNotNull):
                yield f
            elif not isinstance(f, IsNotNull):  # no path is null
                (self.equal if isinstance(f, EqualTo) else self.begins).append(f.value)

    def wanted(self, path: str) -> bool:
        return all(path == x for x in self.equal) and all(path.startswith(x) for x in self.begins)

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise TreeError(f"not a directory: {self.root}")
        files, hidden = walk(self.root, self.extensions, self.exclude)
        if self.table == "excluded":
            return [Hidden(hidden)]
        packs, held = [[]], 0
        for n, (path, size) in enumerate(files):
            if not self.wanted(path):
                continue
            if packs[-1] and held + size > self.size:
                packs.append([])
                held = 0
            packs[-1].append((n, path))
            held += size
        return [Pack(p) for p in packs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Hidden):
            yield from partition.rows
            return
        for n, path in partition.files:
            with open(os.path.join(self.root, *path.split("/")), "rb") as f:
                yield n, path, f.read()


class PhpTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "php_tree"

    def schema(self) -> str:
        return HIDDEN if self.options.get("table") == "excluded" else FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
