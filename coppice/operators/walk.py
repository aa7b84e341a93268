"""A directory tree listed by tasks: directories are a table that each round expands by one level.

Nothing but the number of directories of a round comes to the driver; the rounds
are as many as the tree is deep.  The rules are those of the ``php_tree``
reader: links are not followed and linked files are left out, a directory whose
name is excluded hides all below it (the outermost one counts, with every
matching name in it, linked or not), unreadable directories are logged and left
out, and paths are relative with slashes.  The folder must be one that all
executors see.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.scan import EXCLUDED, EXTENSIONS, with_ids
from coppice.operators.written import written

_FOUND = "role string, path string, size long, hidden string"
#: Directories a task lists on average, and bytes of files it reads.
TASK_DIRS, TASK_BYTES = 64, 16 << 20


def entries_of(root: str, folder: str, hidden: str | None, extensions: tuple[str, ...], exclude: tuple[str, ...]) -> list[tuple]:
    """(role, path, size, hidden) of what one directory holds: dirs to go on with, files, and names below a hidden directory."""
    out: list[tuple] = []
    try:
        with os.scandir(os.path.join(root, *folder.split("/")) if folder else root) as found:
            listed = list(found)
    except OSError as e:
        logging.getLogger(__name__).warning("cannot list %s: %s", folder, e.strerror)
        return out
    for x in listed:
        path = f"{folder}/{x.name}" if folder else x.name
        if x.is_dir():
            if hidden is None and x.name in exclude:
                out.append(("dir", path, 0, path))  # even a linked one
            elif not x.is_symlink():
                out.append(("dir", path, 0, hidden))
        elif x.name.lower().endswith(extensions):
            if hidden is not None:
                out.append(("name", path, 0, hidden))
            elif stat.S_ISREG((info := x.stat(follow_symlinks=False)).st_mode):
                out.append(("file", path, info.st_size, None))
    return out


def walked(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED) -> tuple[DataFrame, DataFrame]:
    """(path, size) of the files, and (dir, files) of the excluded directories that hide any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, hidden in zip(batch.column("path").to_pylist(), batch.column("hidden").to_pylist(), strict=True):
                rows = entries_of(root, folder, hidden, tuple(extensions), tuple(exclude))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["role", "path", "size", "hidden"])

    level = spark.createDataFrame([("", None)], "path string, hidden string")
    found, n = spark.createDataFrame([], _FOUND), 1
    while n:
        here = written(level.repartition(max(1, -(-n // TASK_DIRS))).mapInArrow(run, _FOUND))
        found = found.unionByName(here)
        level = here.where("role = 'dir'").select("path", "hidden")
        n = level.count()
    return found.where("role = 'file'").select("path", "size"), found.where("role = 'name'").groupBy(F.col("hidden").alias("dir")).agg(F.count("*").alias("files"))


def read_walked(files: DataFrame, root: str) -> DataFrame:
    """(file_ord, path, content) of (path, size): numbered by ranges of paths, read by tasks that share out the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, path in zip(batch.column("file_ord").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with open(os.path.join(root, *path.split("/")), "rb") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([path]), pa.array([f.read()], pa.binary())], ["file_ord", "path", "content"])

    numbered = written(with_ids(files).select("file_ord", "path", "size"))
    tasks = max(1, -(-(numbered.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    return numbered.repartition(tasks, "file_ord").mapInArrow(run, "file_ord long, path string, content binary")
