"""Tables of sorted 64-bit keys with values, written by tasks and mapped into memory by workers.

Keys are hashes, so their top bits deal them evenly to shards; a shard is one
file, its sorted keys followed by its columns of values.  A task writes under a
name of its own and renames, and what it writes depends on its rows alone, so a
repeated attempt puts the same file in place.  Workers map files when a look-up
first needs them: pages that are not asked for are not read, and those that are
belong to the page cache, not to the worker.  Where the folder is not of the
local file system, a worker maps copies in its own temporary folder.

Between tasks entries move packed, a row a task and shard; ``reduced`` hands all
rows of one shard to a function, and a shard's size is bounded by their number.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import mapped
from .warc_bundles import open_folder

#: Entries a shard gets on average, counting each as often as it occurs.
SHARD_ENTRIES = 1 << 21
#: Files a reader of one table has mapped at once; a process may not map any number.
MOST_MAPPED = 4096


def bits_for(entries: float) -> int:
    """How many top bits of a key name its shard."""
    return max(1, min(24, int(np.ceil(np.log2(max(1.0, entries / SHARD_ENTRIES))))))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First places of the distinct keys in their order, and the sums of each of ``counts`` over equal keys."""
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return order, *(np.zeros(0, np.int64) for _ in counts)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order[starts], *(np.add.reduceat(c[order].astype(np.int64), starts) for c in counts)


def reduced(rows: DataFrame, shards: int, function: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function(shard, its rows)`` for each shard; ``rows`` have a column shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in batch.to_pylist())
        for shard, own in groupby(each, key=lambda r: r["shard"]):
            yield from function(shard, list(own))

    return mapped(rows.repartition(shards, "shard").sortWithinPartitions("shard"), run, schema)


@dataclass
class Table:
    """A table below ``folder``; ``columns`` are (name, type) of its values and ``sizes`` the entries of each shard."""

    folder: str
    name: str
    bits: int
    columns: list[tuple[str, str]]
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def shards(self) -> int:
        return 1 << self.bits

    def path(self, root: str, shard: int) -> str:
        return f"{root}/{self.name}/{shard:08d}"

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """One shard: distinct keys in order, and a value of every column for each."""
        system, root = open_folder(self.folder)
        system.create_dir(f"{root}/{self.name}", recursive=True)
        own = f"{self.path(root, shard)}.{uuid.uuid4().hex}"
        with system.open_output_stream(own, compression=None) as out:
            out.write(keys.astype("<u8").tobytes())
            for (_, kind), column in zip(self.columns, values, strict=True):
                out.write(column.astype(kind).tobytes())
        system.move(own, self.path(root, shard))

    def of(self, sizes: list[tuple[int, int]]) -> Table:
        """The table with the (shard, entries) that were written: one number a shard."""
        known = np.zeros(self.shards, np.int64)
        for shard, n in sizes:
            known[shard] = n
        return Table(self.folder, self.name, self.bits, self.columns, known)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Look-ups in a table, by a worker that maps its files as they are needed."""

    def __init__(self, table: Table):
        self.table = table
        self.offsets = np.concatenate([[0], np.cumsum(table.sizes)])
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        self.system, self.root = open_folder(table.folder)
        self.starts = np.arange(1, table.shards, dtype=np.uint64) << np.uint64(64 - table.bits)

    def shard(self, n: int) -> tuple[np.ndarray, ...]:
        """Keys and columns of a shard, mapped."""
        if n not in self.held:
            entries, path = int(self.table.sizes[n]), self.table.path(self.root, n)
            if self.system.type_name != "local":
                copy = os.path.join(tempfile.gettempdir(), f"{self.table.name}-{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}-{os.getpid()}")
                with self.system.open_input_stream(path) as source, open(copy, "wb") as out:
                    while block := source.read(8 << 20):
                        out.write(block)
                path = copy
            whole = np.memmap(path, np.uint8, "r")
            if len(whole) != entries * (8 + sum(np.dtype(k).itemsize for _, k in self.table.columns)):
                raise ValueError(f"{path} does not hold {entries} entries")
            parts, at = [], 0
            for kind in ("<u8", *(k for _, k in self.table.columns)):
                size = entries * np.dtype(kind).itemsize
                parts.append(whole[at : at + size].view(kind))
                at += size
            if len(self.held) >= MOST_MAPPED:
                self.held.clear()
            self.held[n] = tuple(parts)
        return self.held[n]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each key its place in the whole table (-1 where it is not), and its value in every column (0 there)."""
        order = np.argsort(keys)
        ranked = keys[order]
        bounds = np.concatenate([[0], np.searchsorted(ranked, self.starts), [len(ranked)]])
        place = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), kind) for _, kind in self.table.columns]
        for n in np.flatnonzero(np.diff(bounds)):
            if not self.table.sizes[n]:
                continue
            a, b = bounds[n], bounds[n + 1]
            held, *columns = self.shard(int(n))
            at = np.minimum(np.searchsorted(held, ranked[a:b]), len(held) - 1)
            hit = np.flatnonzero(held[at] == ranked[a:b])
            to, at = order[a:b][hit], at[hit]
            place[to] = at + self.offsets[n]
            for out, column in zip(values, columns, strict=True):
                out[to] = column[at]
        return place, *values
