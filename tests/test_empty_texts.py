"""Queries on tables with empty texts against their SQL."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coppice.operators import checks, lexing
from coppice.plans.extract import Look, extract

NAMES = ("ast_documents", "page_documents", "dominant_dir", "top_dirs", "tree_totals", "paths_under", "path_lookup", "wrapped_nodes", "edge_table", "kind_counts", "node_slices", "script_nodes", "script_edges", "nodes_under", "violations")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of which those of ids 7 and 20 to 29 are empty, one of every last digit."""
    folder = tmp_path_factory.mktemp("tables")
    texts = [(i, "" if i == 7 or i >= 20 else f"Text {i}.\nMore." + "\n" * (i % 3), ("en", "de", "fr", "es")[(i + 1) % 4], f"src{i % 10 if i != 28 else 1}") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "<p>"), (2, ""), (3, "<i>\n</i>")], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.sql(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    got, expected = entry.queries()[name](spark, tables), db.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, expected.select(*columns).fetchall()))


SOURCES = {
    b"": [(0, 0)], b"<?php a(); ?>": [(13, 13)], b"<?php a(); ?>\r\n": [(15, 15)], b"\n<?= 1 ?>": [(0, 1), (9, 9)], b"<?php if ($a) { b(); } else c() ?><?php // d ?>": [(47, 47)],
    b"<?php f( ?>": [(11, 11)], b"<?php a();": [], b"<?php a(); ?>\n\n": [(14, 15)], b"<?php '?>": [],
}


def test_empty_text_behind_the_last_tag(spark):
    files = spark.createDataFrame([(i, f"{i}.php", x) for i, x in enumerate(SOURCES)], "file_ord long, path string, content binary")
    x = extract(files, look=Look(True, False), empty_text=True)
    docs = {r.file_ord: json.loads(r.ast_json) for r in x.docs.select("file_ord", "ast_json").collect()}
    html = [[n for n in docs[i]["nodes"] if n["kind"] == "Stmt_InlineHTML"] for i in range(len(SOURCES))]
    assert [[(n["loc"]["startByte"], n["loc"]["endByte"]) for n in found] for found in html] == list(SOURCES.values())
    empty = [n for found in html for n in found if n["loc"]["startByte"] == n["loc"]["endByte"]]
    assert len(empty) == 6 and all(n["attrs"] == {"value": ""} and n["parent"].endswith("#00000") and n["loc"]["startLine"] == n["loc"]["endLine"] for n in empty)
    assert all(d["nodes"][0]["children"][-1] == d["nodes"][-1]["id"] for i, d in docs.items() if html[i])
    rows, nodes = x.rows.cache(), x.nodes.cache()
    assert rows.count() == nodes.count() == sum(d["nodeCount"] for d in docs.values())
    found = [checks.broken_parents(nodes), checks.stray_children(nodes), checks.field_mismatches(nodes, x.edges), checks.repeated_ids(nodes), checks.unordered_children(nodes)]
    assert [df.count() for df in found] == [0] * 5
    assert rows.where("kind = 'Stmt_InlineHTML' and (subtree_end <> node_ord + 1 or parent_ord <> 0)").count() == 0
    by_size = [sorted(map(repr, lexing.items(files.where(F.octet_length("content") > 0), size, empty_text=True).collect())) for size in (4, 1 << 20)]
    assert by_size[0] == by_size[1]
