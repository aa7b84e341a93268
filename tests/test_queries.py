"""Every query with SQL against DuckDB, on a small folder of tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def rows(table, columns):
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, r)) for r in table[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(TABLES):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from '{TABLES}/{file}'")
    got, expected = entry.queries()[name](spark, TABLES).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got, sorted(got.columns)) == rows(expected, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
