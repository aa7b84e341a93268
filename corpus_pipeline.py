"""Documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept; all but the last return
the columns of documents.  Near copies are sets of five-word shingles with a
similarity of 0.8 or more.

Defined cases: a null, empty or wordless text fails the quality rules and goes;
rows equal in doc_id and text are one document to the near-duplicate stage,
which keeps it once; rows with a null doc_id are kept where nothing with an id is
their copy; texts of any length go through whole; an empty table stays empty;
further columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import mixing, ngram_join, packing, pii, quality_rules
from coppice.llm.shared import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest doc_id."""
    return ngram_join.keep_first(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each source what its weight allows, a row a copy."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise the copies and pack them into sequences, one row a piece."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]
#: Iterated label model, connected components and token packing: SQL can't express them; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
