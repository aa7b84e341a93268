"""Discovery over any DataFrame of paths: filter, exclude, count what was excluded, order, number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import columns as C
from coppice.operators.written import written

EXTENSIONS, EXCLUDED = (".inc", ".php"), (".git", "node_modules")


def _outermost(path: str, names: tuple[str, ...]):
    """The path up to its first directory named in ``names``, or null."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    hit = F.array_min(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.nullif(F.array_position(dirs, n), F.lit(0)))) if names else F.lit(None).cast("long")
    return F.when(hit.isNotNull(), F.array_join(F.slice(dirs, F.lit(1), hit.cast("int")), "/"))


def discover(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Files with a wanted extension, outside directories whose name is excluded at any depth."""
    return files.where(C.has_extension(F.col("path"), list(extensions)) & _outermost("path", exclude).isNull())


def excluded(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(dir, files): matching files below each outermost excluded directory that has any."""
    hidden = files.where(C.has_extension(F.col("path"), list(extensions))).select(_outermost("path", exclude).alias("dir")).where("dir is not null")
    return hidden.groupBy("dir").agg(F.count("*").alias("files"))


def numbered(keys: DataFrame, by: tuple[str, ...] = ("path",), name: str = "file_ord") -> DataFrame:
    """(by, name): dense numbers from 0 in byte order of the columns ``by``, null first; of equal keys one row, with the first of their numbers.

    Distinct keys and how often they occur are range-partitioned and summed
    inside each partition; the partitions' sums, one row each, give the offsets.
    No task sees all keys.
    """
    counted = keys.groupBy(*by).agg(F.count("*").alias("__n"))
    # The ranges are sampled, so they are fixed once.
    spread = written(counted.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sizes = spread.groupBy("__part").agg(F.sum("__n").alias("__n"))
    # One row a partition, so this window is small whatever the input.
    offsets = sizes.select("__part", (F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    inner = spread.withColumn("__own", F.sum("__n").over(W.partitionBy("__part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    return inner.join(offsets, "__part").select(*by, (F.col("__own") + F.col("__before")).alias(name))


def with_ids(files: DataFrame) -> DataFrame:
    """``files`` with file_ord and file_id, a number of its own for every row.

    Rows are numbered by path, those of one path by the hash of their content;
    rows equal in both are told apart in no particular order.  A null path comes
    first.  The numbering sees paths and hashes alone, and contents meet it in a
    join by them.
    """
    hashed = files.withColumn("__hash", F.sha2("content", 256) if "content" in files.columns else F.lit(""))
    first = numbered(hashed, ("path", "__hash"), "__first").withColumnsRenamed({"path": "__path", "__hash": "__same"})
    met = hashed.join(first, F.col("path").eqNullSafe(F.col("__path")) & F.col("__hash").eqNullSafe(F.col("__same")))
    equal = F.row_number().over(W.partitionBy("__path", "__same").orderBy("__first")) - 1
    out = met.withColumn("file_ord", (F.col("__first") + equal).cast("long")).drop("__hash", "__path", "__same", "__first")
    return out.withColumn("file_id", C.file_id(F.col("file_ord")))


def line_starts(files: DataFrame) -> DataFrame:
    """(path, line, start): the byte offset at which each line begins; rows of one path have lines each, a null content none."""
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(places_of(10)("content"), lambda x: x + 1))
    return files.select("path", F.posexplode(begins).alias("pos", "start")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "start")


def places_of(byte: int):
    """A function from contents to the places of a byte in them, in order; null of null."""

    @F.arrow_udf("array<bigint>")
    def places(contents: pa.Array) -> pa.Array:
        found = [None if c is None else np.flatnonzero(np.frombuffer(c, np.uint8) == byte) for c in contents.to_pylist()]
        return pa.array(found, pa.list_(pa.int64()))

    return places
