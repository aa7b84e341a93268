"""Running totals within groups of any size, in the order of a hash-random key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a range of keys holds on average.
RANGE = 4096


def with_running_total(df: DataFrame, group: str, order: list[str], value: str, n_rows: int, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come earlier.

    ``order[0]`` is a hex string uniform over its range, such as md5.  Its
    leading digits cut every group into ranges of about RANGE rows, so no task
    holds a whole group: totals a range are summed first, a window over ranges
    gives where each begins, and a window inside a range does the rest.
    """
    ranges = 1 << max(4, min(28, (n_rows // RANGE).bit_length()))
    df = df.withColumn("__range", F.expr(f"cast(conv(substring(`{order[0]}`, 1, 7), 16, 10) as long) * {ranges} div {1 << 28}"))
    # The window over ranges is itself cut by the high bits of the range, so neither it grows with the group.
    coarse = 1 << (ranges.bit_length() // 2)
    totals = df.groupBy(group, "__range").agg(F.sum(value).alias("__sum")).withColumn("__coarse", F.expr(f"__range * {coarse} div {ranges}"))
    heads = totals.groupBy(group, "__coarse").agg(F.sum("__sum").alias("__coarse_sum"))
    heads = heads.withColumn("__coarse_begin", F.sum("__coarse_sum").over(W.partitionBy(group).orderBy("__coarse")) - F.col("__coarse_sum")).drop("__coarse_sum")
    inner = W.partitionBy(group, "__coarse").orderBy("__range")
    begins = totals.withColumn("__in", F.sum("__sum").over(inner) - F.col("__sum"))
    same = lambda a, b: a[group].eqNullSafe(b[group])
    begins = begins.alias("t").join(heads.alias("h"), same(begins, heads) & (begins["__coarse"] == heads["__coarse"]))
    begins = begins.select(F.col(f"t.{group}").alias("__group"), F.col("t.__range").alias("__at"), (F.col("__in") + F.col("__coarse_begin")).alias("__begin"))
    within = W.partitionBy(group, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("__own", F.sum(value).over(within) - F.col(value))
    rows = rows.join(begins, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at")))
    return rows.withColumn(name, F.col("__own") + F.col("__begin")).drop("__range", "__own", "__group", "__at", "__begin")
