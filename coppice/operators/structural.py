"""Ancestors and descendants: which nodes of one kind stand under which of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contained(nodes: DataFrame, inner: Column, outer: Column) -> DataFrame:
    """(file_ord, outer_ord, node_ord, between): every node for which ``inner`` holds under each one for which ``outer`` does.

    ``between`` counts the outer nodes between the two, 0 for the nearest.  The
    numbers of a subtree are a range, and ranges nest, so this is the stack of a
    sort-merge join: an outer node opens a level and its range's end closes it;
    an inner node has an ancestor on every level open around it, the last one
    opened there.  The work is the nodes of either kind and the pairs found; no
    two nodes are compared.  A node is not under itself.  Nodes with a null
    number or file find nothing.
    """
    place = lambda at, step, role: F.struct(at.cast("int").alias("at"), F.lit(step).alias("step"), F.lit(role).alias("role"))
    # Where one range ends another may begin; a node is looked for before it opens a level itself.
    ends, looks, begins = place(F.col("subtree_end"), 0, "end"), place(F.col("node_ord"), 1, "look"), place(F.col("node_ord"), 2, "begin")
    is_inner, is_outer = F.coalesce(inner, F.lit(False)), F.coalesce(outer, F.lit(False))
    roles = F.concat(F.when(is_outer, F.array(begins, ends)).otherwise(F.array().cast(_ROLES)), F.when(is_inner, F.array(looks)).otherwise(F.array().cast(_ROLES)))
    events = nodes.where("file_ord is not null and node_ord is not null").where(is_inner | is_outer).select("file_ord", "node_ord", F.explode(roles).alias("e")).select("file_ord", "node_ord", "e.*")
    before = W.partitionBy("file_ord").orderBy("at", "step").rowsBetween(W.unboundedPreceding, -1)
    change = F.when(F.col("role") == "begin", 1).when(F.col("role") == "end", -1).otherwise(0)
    events = events.withColumn("open", F.coalesce(F.sum(change).over(before), F.lit(0))).where("role <> 'end'")
    around = F.when(F.col("role") == "begin", F.array(F.col("open") + 1)).when(F.col("open") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("open")))
    leveled = events.withColumn("level", F.explode(around))
    opened = F.last(F.when(F.col("role") == "begin", F.col("node_ord")), ignorenulls=True)
    found = leveled.withColumn("outer_ord", opened.over(W.partitionBy("file_ord", "level").orderBy("at", "step").rowsBetween(W.unboundedPreceding, 0)))
    return found.where("role = 'look'").select("file_ord", "outer_ord", "node_ord", (F.col("open") - F.col("level")).cast("int").alias("between"))


_ROLES = "array<struct<at:int,step:int,role:string>>"
