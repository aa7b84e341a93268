"""Small helpers the operators share: tables, checkpoints, batch slicing."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Texts are handled in slices of about this many bytes, so a Python worker's
#: memory does not follow the Arrow batch size.
SLICE_BYTES = 512 << 10

#: Bytes of an Arrow batch between Spark and a Python worker (a longer row is a batch by itself).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own if all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="coppice-")


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, unless the session sets a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_in_round(df: DataFrame) -> DataFrame:
    """``cut`` for a frame of few columns that each round of a loop makes from its last one by joins.

    A checkpoint keeps the size that Spark reckoned for its plan, where a join is
    the product of its sides.  From round to round the digits of that size would
    multiply, and reckoning with them takes the driver's memory and time.  A
    frame made from the checkpoint's rows has no such past.
    """
    session, held = df.sparkSession, cut(df)._jdf
    return DataFrame(session._jsparkSession.createDataFrame(held.toJavaRDD(), held.schema()), session)


#: A table of one row a key is broadcast up to this many rows, and joined by shuffling beyond.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialised before) with a broadcast hint if it has few rows, so the other side stays where it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames that nothing refers to any more.

    Its cleaner waits for the driver's garbage collection, which a driver with
    little to do may not run for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array) -> pa.Array:
    """A string column as large_string with nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows holding about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, n in enumerate(lengths):
            if row > start and held + n > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(n)
        if start < len(lengths):
            yield batch.slice(start)
