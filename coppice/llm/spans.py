"""Spans found in texts: their written form, digests, and a runner over whole documents."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, slices, texts_of

Span = tuple[int, int, str]  # start, end (code points, end exclusive), kind


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end of each span, by start and then in the order of ``kinds``, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


class Occupied:
    """The places that spans take, as sorted disjoint ranges, so that a look-up does not walk them all."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        """Take a range that is free."""
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def span_table(docs: DataFrame, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], base_kinds: tuple[str, ...], more_kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count n_<kind> of each base kind, base_sha256, spans (all, written), n_added.

    ``find()`` is called once a task and gives a function from a text to its base spans and added spans.
    """
    names = ["doc_id", *(f"n_{k}" for k in base_kinds), "base_sha256", "spans", "n_added"]
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in base_kinds), "base_sha256 string", "spans string", "n_added long"])
    kinds = (*base_kinds, *more_kinds)
    empty = digest([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = find()
        for batch in slices(batches, "text"):
            counts, digests, texts, added = {k: [] for k in base_kinds}, [], [], []
            for text in texts_of(batch.column("text")).to_pylist():
                base, more = spans_of(text)
                for k in base_kinds:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(digest(base, kinds) if base else empty)
                texts.append(written(base + more, kinds))
                added.append(len(more))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in base_kinds), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans share the first one's."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
