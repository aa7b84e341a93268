"""What rounds leave behind: Spark's own estimate of a size must not grow from round to round."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.llm import components, ngram_join


def size_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_of_components_stay_bounded(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(chain)
    assert {(r.id, r.label) for r in found.collect()} == {(i, 0) for i in range(61)}
    assert size_bits(found) < 256


def test_estimates_of_merged_labels_stay_bounded(spark):
    labels = spark.range(16).select(F.col("id").alias("node"), F.col("id").alias("label"))
    for step in (8, 4, 2):  # what is linked has fewer labels each time
        labels = ngram_join.merged(labels, spark.range(16 - step).select(F.col("id").alias("a"), (F.col("id") + step).alias("b")))
        assert {(r.node, r.label) for r in labels.collect()} == {(i, i % step) for i in range(16)}
        assert size_bits(labels) < 256
