"""JSON by column expressions beside json.dumps."""

from __future__ import annotations

import json
import random
import struct

from pyspark.sql import functions as F

from coppice.functions import json_columns as J
from coppice.functions.literals import canonical, scalar, typed
from coppice.plans.extract import _fields_json, extract


def test_doubles(spark):
    draw = random.Random(5)
    values = [0.0, -0.0, 1.0, 5e-324, 1.5e-323, 2.2250738585072014e-308, 1.7976931348623157e308, 1e15, 1e16, 1e-4, 1e-5, 0.1, 1 / 3, 2e23, 9007199254740993.0]
    values += [2.0**k for k in range(-1074, 1024, 3)] + [-3 * 2.0**k for k in range(-1070, 1020, 7)] + [10.0**k for k in range(-323, 309, 5)]
    bits = (struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(2000))
    values += [x for x in bits if abs(x) < float("inf")] + [round(draw.uniform(-1e4, 1e4), draw.randrange(12)) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", J.real(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if repr(r.x) != r.t] == []


def test_scalars_and_levels(spark):
    values = ["", 'a"\\\n\x1f é\U0001f600', b"\xff\x00", True, False, 0, -(2**63), 2.5, float("nan"), float("-inf"), b"x" * 300_000]
    df = spark.createDataFrame([(i, typed(v)) for i, v in enumerate(values)], f"i int, s {J.SCALAR}").withColumn("t", J.text_of(F.col("s")))
    got = df.orderBy("i").select(J.scalar(F.col("t")).alias("compact"), J.object_of({"k": J.listed(F.array(J.scalar(F.col("t"), 2)), 1), "e": J.listed(F.array().cast("array<string>"), 1)}, 0).alias("deep")).collect()
    plain = [scalar(v) for v in values]
    assert [r.compact for r in got] == [canonical(v) for v in plain]
    assert [r.deep for r in got] == [canonical({"k": [v], "e": []}, 1) for v in plain]
    assert spark.createDataFrame([(None,)], f"s {J.SCALAR}").select(J.scalar(J.text_of(F.col("s")))).first()[0] == "null"


def test_scalar_in_a_list(spark):
    edges = [("names", 0, 3, None), ("names", 1, None, (None, "1.5")), ("names", 2, None, None), ("names", 3, None, ("__b64", '"/w=="'))]
    df = spark.createDataFrame([("f000", [("names", True), ("default", False)], edges)], f"file string, fields array<struct<name:string,many:boolean>>, edges array<struct<field:string,pos:int,child_ord:int,scalar:{J.TEXT}>>")
    expected = {"default": None, "names": ["f000#00003", {"__scalar": 1.5}, None, {"__scalar": {"__b64": "/w=="}}]}
    for level, indent in ((None, None), (0, 1)):
        assert df.select(_fields_json(F.col("file"), F.col("fields"), F.col("edges"), level)).first()[0] == canonical(expected, indent)


def test_documents_in_both_layouts(spark):
    sources = [b"", b"no tag \xff", b"<?php $v = [1_0, 1e1000, 9223372036854775808, 1.0, '\xe9', \"\\x41\\u{e9}\\n\", ($c), 2.5e-7, [, $x]]; ?>tail", b"<?php if ($a) { b(); } else c();", b"<?php f(; "]
    files = spark.createDataFrame([(i, f'{i}/"é".php', s) for i, s in enumerate(sources)], "file_ord int, path string, content binary")
    for pretty, indent in ((False, None), (True, 1)):
        for r in extract(files, pretty).docs.select("ast_json").collect():
            assert r.ast_json == canonical(json.loads(r.ast_json), indent) + "\n"
