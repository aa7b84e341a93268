"""Roll-ups of the files table: totals, directories, dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import columns as C


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("node_count"), F.lit(0)).cast("long").alias("nodes"), F.count_if(~F.col("parse_ok")).alias("parse_failures"))


def by_top_dir(files: DataFrame) -> DataFrame:
    return files.groupBy(C.top_dir(F.col("path")).alias("top")).agg(F.sum("node_count").cast("long").alias("nodes"), F.count("*").alias("files"))


def dominant_dir(files: DataFrame) -> DataFrame:
    """The top directory with most nodes (ties to the smaller name) and its share; sums and total come from one pass."""
    sums = files.withColumn("top", C.top_dir(F.col("path"))).rollup("top").agg(F.sum("node_count").cast("long").alias("nodes"), F.grouping("top").alias("all"))
    first = F.min(F.when(F.col("all") == 0, F.struct((-F.col("nodes")).alias("less"), "top")))
    both = sums.agg(first.alias("first"), F.max(F.when(F.col("all") == 1, F.col("nodes"))).alias("total")).where("first is not null")
    return both.select("first.top", (-F.col("first.less")).alias("nodes"), (-F.col("first.less") / F.col("total")).alias("share"))


def dominance_warning(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The dominant directory where a warning is due: not the root itself, and at least ``threshold`` of all nodes."""
    return dominant_dir(files).where((F.col("top") != "(root)") & (F.col("share") >= threshold))


def kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))
