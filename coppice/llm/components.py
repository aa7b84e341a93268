"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_in_round, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every end of a link; label is the smallest id of its component.

    Each round takes the smallest label among neighbours and then the label's
    own label, so long chains halve instead of shrinking by one.  Rounds are
    written to the shared folder; nothing but the number of changes reaches the
    driver.  Links without an end or from an id to itself are ignored.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut_in_round(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_in_round(edges.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("label")))
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.id == near.u).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label is an id of the same component, at times without a row of its own changed this round.
        of = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut_in_round(new.join(of, "label", "left").select("id", "old", F.least("label", "further").alias("label")))
        labels = new.select("id", "label")
        settled = new.where("old <> label").isEmpty()
        del near, new, of
        release(links.sparkSession)
        if settled:
            return labels
