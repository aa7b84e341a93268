"""Consistency checks: each returns the violations, none when all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.written import written


def broken_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent does not exist or does not list them as a child."""
    child = nodes.where("parent_ord is not null").select("file_ord", "node_ord", "parent_ord", "id")
    listed = nodes.select("file_ord", F.col("node_ord").alias("parent_ord"), F.explode("children").alias("id"))
    return child.join(listed, ["file_ord", "parent_ord", "id"], "left_anti")


def stray_children(nodes: DataFrame) -> DataFrame:
    """Listed children that do not exist or have another parent."""
    listed = nodes.select("file_ord", F.col("node_ord").alias("parent_ord"), F.explode("children").alias("id"))
    return listed.join(nodes.select("file_ord", "parent_ord", "id"), ["file_ord", "parent_ord", "id"], "left_anti")


def field_mismatches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose fields and children name different ids."""
    named = edges.where("child_ord is not null").groupBy("file_ord", F.col("parent_ord").alias("node_ord")).agg(F.collect_set("child_id").alias("named"))
    both = nodes.join(named, ["file_ord", "node_ord"], "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    return both.where((F.size(F.array_except("named", "children")) > 0) | (F.size(F.array_except("children", "named")) > 0)).select("file_ord", "node_ord")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").count().where("count > 1")


def unordered_children(nodes: DataFrame) -> DataFrame:
    """Listed children whose number is not greater than their parent's, or than that of the one listed before them."""
    number = lambda c: F.split_part(c, F.lit("#"), F.lit(-1)).cast("int")
    one = lambda id, i: F.struct(id.alias("id"), number(id).alias("child"), number(F.get("children", i - 1)).alias("before"))
    child = nodes.select("file_ord", "node_ord", F.inline(F.transform("children", one)))
    return child.where("child <= node_ord or child <= before").drop("before")


def tree_diff(a: DataFrame, b: DataFrame, key: str = "path", value: str = "ast_sha256") -> DataFrame:
    """One row a key: left_only, right_only, differs, or same."""
    left, right = a.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")), b.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    joined = left.join(right, key, "full")
    status = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("differs")
    return joined.select(key, status.alias("status"))


def reconciled(a: DataFrame, b: DataFrame, key: str = "path", value: str = "ast_sha256", ranges: int = 1 << 14) -> DataFrame:
    """The rows of ``tree_diff`` where few differ: sums of ranges of keys are compared first, and only ranges that differ are joined.

    A range is a part of the keys by hash; its sum is the number of its rows and
    two sums of 64-bit hashes of key and value, which a task adds up before they
    move.  Rows of equal ranges stay where they are.  Two ranges with the same
    sums but other rows need a coincidence in 128 bits.  Repeated keys are joined
    with one another as in ``tree_diff`` where their range differs; where it does
    not, each row stands once.  A null key is in one side alone, as there.
    """
    range_of = F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), key, value).cast("decimal(20,0)"))
    placed = lambda df: df.select(key, value, range_of.alias("__range"))
    left, right = placed(a), placed(b)
    sums = lambda df, side: df.groupBy("__range").agg(F.struct(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), total(3).alias("x"), total(5).alias("y")).alias(side))
    both = sums(left, "l").join(sums(right, "r"), "__range", "full")
    other = written(both.where(~F.col("l").eqNullSafe(F.col("r")) | (F.coalesce("l.nulls", F.lit(0)) > 0)).select("__range"))
    few = F.broadcast(other)  # a number a range at most
    same = left.join(few, "__range", "left_anti").select(key, F.lit("same").alias("status"))
    return same.unionByName(tree_diff(left.join(few, "__range", "left_semi"), right.join(few, "__range", "left_semi"), key, value))


def changed_bytes(files: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Entries whose hash or size differs from one recomputed from the bytes (path, sha256, bytes)."""
    return files.select("path", "sha256", "bytes").exceptAll(recomputed.select("path", "sha256", "bytes"))


def unlisted_files(files: DataFrame, written: DataFrame) -> DataFrame:
    """Paths of documents (column ast) that only the manifest or only the folder has."""
    listed, found = files.select("ast"), written.select("ast")
    return listed.exceptAll(found).union(found.exceptAll(listed))
