"""A whole directory: read, analyse, write, and read back."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.scan import EXCLUDED, EXTENSIONS
from coppice.plans.extract import Extraction, extract
from coppice.sources.ast_dir import COLUMNS, ENTRY, AstDir, write_manifest
from coppice.sources.php_tree import PhpTree, TreeError, normal_extensions


def read_tree(spark: SparkSession, root: str, extensions=EXTENSIONS, exclude=EXCLUDED, table: str = "files") -> DataFrame:
    """The files of a directory (file_ord, path, content), or its excluded directories."""
    if not os.path.isdir(root):
        raise TreeError(f"not a directory: {root}")
    spark.dataSource.register(PhpTree)
    options = {"extensions": ",".join(normal_extensions(extensions)), "exclude": ",".join(exclude), "table": table}
    return spark.read.format("php_tree").options(**options).load(os.path.abspath(root))


def write_tree(extraction: Extraction, out: str, excluded: list[dict] | None = None, extensions=EXTENSIONS) -> dict:
    """Write documents and manifest below ``out``; the manifest is returned without its list of files (``manifest_entries`` has that)."""
    spark, out = extraction.docs.sparkSession, os.path.abspath(out)
    spark.dataSource.register(AstDir)
    extraction.docs.select([c.split()[0] for c in COLUMNS.split(", ")]).write.format("ast_dir").mode("overwrite").save(out)
    return write_manifest(spark, out, excluded or [], list(extensions))


def extract_tree(spark: SparkSession, root: str, out: str, extensions=EXTENSIONS, exclude=EXCLUDED, pretty: bool = False) -> dict:
    """Analyse a directory into ``out`` and return the manifest without its list of files."""
    extensions = normal_extensions(extensions)
    files = read_tree(spark, root, extensions, exclude)
    hidden = [r.asDict() for r in read_tree(spark, root, extensions, exclude, "excluded").collect()]  # one row a directory
    return write_tree(extract(files, pretty), out, hidden, extensions)


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """The written documents as rows (path, text, sha256 of the file)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(os.path.join(os.path.abspath(out), "ast"))
    return raw.select(F.regexp_extract("path", r"(ast/[^/]+)$", 1).alias("ast"), F.col("content").cast("string").alias("ast_json"), F.sha2("content", 256).alias("ast_sha256"))


def manifest_entries(spark: SparkSession, out: str) -> DataFrame:
    """The entries of a written manifest as rows."""
    manifest = spark.read.option("multiLine", True).schema(f"files array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").json(os.path.join(os.path.abspath(out), "manifest.json"))
    return manifest.select(F.explode("files").alias("e")).select("e.*")


def written_document(spark: SparkSession, out: str, path: str) -> DataFrame:
    """The written document of one source path: its entry met with what stands in the folder."""
    return manifest_entries(spark, out).where(F.col("path") == path).join(read_documents(spark, out), "ast")


def extract_file(spark: SparkSession, path: str, file_id: str) -> dict:
    """One file by itself, through the same plan as a tree: fileId, rootId, parseErrors, nodes."""
    if not re.fullmatch(r"f[0-9]{3,}", file_id):
        raise ValueError(f"not a file id: {file_id}")
    with open(path, "rb") as f:
        one = spark.createDataFrame([(int(file_id[1:]), os.path.basename(path), f.read())], "file_ord int, path string, content binary")
    doc = json.loads(extract(one).docs.first().ast_json)
    return {k: doc[k] for k in ("fileId", "rootId", "parseErrors", "nodes")}
