"""The ``ast_dir`` sink: one JSON file a row and a manifest over all of them.

Rows have file_id, path, sha256, bytes, node_count, parse_ok,
parse_error_count, ast_json, ast_sha256.  Old output is cleared first, and tasks
write under a temporary name and rename.  The entry of each file goes into a
part file of its task.  ``write_manifest`` deals the entries into ranges of
paths; the tasks of the ranges write their text into the one manifest file, each
where its range begins, once the write of the documents has succeeded, so a
failed run leaves no manifest, and no list of files is held anywhere.  The
folder must be one that all executors and the driver see.

``contentHash`` is the hash of the compact manifest with, in place of the list
of files, the root of a hash tree (operators/hash_tree) over its entries.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from coppice.functions.literals import canonical
from coppice.operators.hash_tree import FAN, root_of
from coppice.operators.written import written
from coppice.plans.extract import PARSER, SCHEMA_VERSION, TOOL

COLUMNS = "file_id string, path string, sha256 string, bytes bigint, node_count int, parse_ok boolean, parse_error_count int, ast_json string, ast_sha256 string"
ENTRY = "ast string, astSha256 string, bytes bigint, fileId string, nodeCount int, parseErrorCount int, parseOk boolean, path string, sha256 string"
PARTS = "ast-entries"


@dataclass
class Written(WriterCommitMessage):
    part: str


def put(out: str, name: str, pieces: Iterable[str]) -> None:
    """A file below ``out``, there whole or not at all."""
    temporary = os.path.join(out, f"{name}.{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        f.writelines(p.encode() for p in pieces)
    os.replace(temporary, os.path.join(out, name))


class Manifest(dict):
    """A manifest without its list of files; ``entries`` are these as rows."""

    entries: DataFrame


def rendered(rows: DataFrame, gap: str) -> DataFrame:
    """(part, seq, path, digest, text) of entries by ranges of paths: the digest of the compact form, and the text as it stands in the manifest behind a comma."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                out.append((part, seq, e["path"], hashlib.sha256(canonical(e).encode()).hexdigest(), "," + gap + canonical(e, 1).replace("\n", "\n" + gap.strip("\n"))))
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["part", "seq", "path", "digest", "text"])

    return rows.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, "part int, seq long, path string, digest string, text string")


def write_manifest(spark: SparkSession, out: str, excluded: list[dict], extensions: list[str], fan: int = FAN) -> Manifest:
    """Write the manifest over the entries that tasks left; it is returned without its list of files.

    The driver sees a sum a range of paths: how many entries it has and how many bytes they take.
    """
    parts = os.path.join(out, PARTS)
    rows = written(spark.read.schema(ENTRY).json(parts) if os.listdir(parts) else spark.createDataFrame([], ENTRY))
    files, nodes, failures = rows.agg(F.count("*"), F.coalesce(F.sum("nodeCount"), F.lit(0)), F.count_if(~F.col("parseOk"))).first()
    head = Manifest(excluded=excluded, extensions=sorted(extensions), parser=PARSER, schemaVersion=SCHEMA_VERSION, tool=TOOL, totals={"files": files, "nodes": nodes, "parseFailures": failures})
    mark = "\0"
    shown = lambda: canonical(head | {"files": [mark]}, 1).split(canonical(mark))
    gap = (text := shown()[0])[text.rindex("[") + 1 :]
    texts = written(rendered(rows, gap))
    ranges = texts.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("part").collect()  # one row a range
    before, at = dict(zip([r.part for r in ranges], accumulate([0, *(r.n for r in ranges)]))), dict(zip([r.part for r in ranges], accumulate([0, *(r.bytes for r in ranges)])))
    first = F.create_map(*[F.lit(x) for part in before.items() for x in part]) if before else F.create_map(F.lit(0), F.lit(0))
    head["contentHash"] = hashlib.sha256(f"{canonical(head | {'files': root_of(texts.select((F.col('seq') + first[F.col('part')]).alias('pos'), 'digest'), fan).first()[0]})}\n".encode()).hexdigest()
    above, below = (x.encode() for x in shown())
    if not files:
        above, below = (canonical(head | {"files": []}, 1)).encode(), b""
    below += b"\n"
    lowest = ranges[0].part if ranges else 0
    skipped, temporary = len("," + gap) if files else 0, os.path.join(out, f".manifest.{uuid.uuid4().hex}")
    size = sum(r.bytes for r in ranges) - skipped
    with open(temporary, "wb") as f:
        f.write(above)
        f.truncate(len(above) + size)
        f.seek(len(above) + size)
        f.write(below)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(temporary, "r+b") as f:
            part = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != part:
                        part = row["part"]
                        f.seek(len(above) + at[part] - skipped * (part != lowest))
                    text = row["text"].encode()
                    f.write(text[skipped:] if part == lowest and row["seq"] == 0 else text)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    texts.mapInArrow(place, "n long").count()  # as written: a range a task, in order
    os.replace(temporary, os.path.join(out, "manifest.json"))
    shutil.rmtree(parts)
    head.entries = rows
    return head


class AstWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.out = options["path"]

    def clear(self) -> None:
        for name in ("ast", PARTS):
            shutil.rmtree(os.path.join(self.out, name), ignore_errors=True)
            os.makedirs(os.path.join(self.out, name), exist_ok=True)
        if os.path.exists(manifest := os.path.join(self.out, "manifest.json")):
            os.remove(manifest)

    def write(self, iterator: Iterator) -> Written:
        part, entries = f"{PARTS}/{uuid.uuid4().hex}.json", os.path.join(self.out, f".{uuid.uuid4().hex}")
        with open(entries, "wb") as f:
            for row in iterator:
                name = f"ast/{row.file_id}.json"
                put(self.out, name, [row.ast_json])
                entry = {"ast": name, "astSha256": row.ast_sha256, "bytes": row.bytes, "fileId": row.file_id, "nodeCount": row.node_count, "parseErrorCount": row.parse_error_count, "parseOk": row.parse_ok, "path": row.path, "sha256": row.sha256}
                f.write(f"{canonical(entry)}\n".encode())
        os.replace(entries, os.path.join(self.out, part))
        return Written(part)

    def commit(self, messages: list[Written]) -> None:
        """Parts of attempts that did not count go."""
        counted = {os.path.basename(m.part) for m in messages if m}
        for name in os.listdir(os.path.join(self.out, PARTS)):
            if name not in counted:
                os.remove(os.path.join(self.out, PARTS, name))

    def abort(self, messages: list[Written]) -> None:
        """Documents that were written stay; there is no manifest."""


class AstDir(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ast_dir"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> AstWriter:
        writer = AstWriter(dict(self.options))
        writer.clear()
        return writer
