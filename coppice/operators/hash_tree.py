"""One hash over any number of rows in order, by way of hashes of runs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digests that one above is made of.
FAN = 1024


def root_of(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest): the root over ``leaves`` (pos, digest), whose places are dense from 0; of none the hash of no bytes.

    A node is the SHA-256 of the hex digests of up to ``fan`` neighbours, joined
    by line feeds; levels are made until one node is left, so a single leaf is
    its own root.  A group has ``fan`` rows at most and every level is a
    grouping of its own, so no task sees all digests.
    """
    n = leaves.count()
    if n == 0:
        return leaves.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("digest"))
    level = leaves.select("pos", "digest")
    while n > 1:
        ranked = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.floor(F.col("pos") / fan).alias("above")).agg(F.sha2(F.array_join(ranked, "\n"), 256).alias("digest")).withColumnRenamed("above", "pos")
        n = -(-n // fan)
    return level.select("digest")
