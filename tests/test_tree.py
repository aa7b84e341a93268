"""Source trees end to end: scan, syntax, documents, manifest, checks, command line."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from coppice import cli
from coppice.functions import columns as C
from coppice.functions.literals import canonical, number, scalar, unquoted
from coppice.operators import checks, rollup, scan
from coppice.plans.extract import extract, lookup
from coppice.plans.tree import extract_file, extract_tree, manifest_entries, read_documents, read_tree, write_tree, written_document
from coppice.sources.php_tree import TreeError, normal_extensions

FILES = {
    "bytes.php": b"<p><?php echo \"k\"; ?>na\xefve \xff</p>",
    "dos.php": b"<h1>top\r\n</h1><?php\r\n  $t = step(2);\r\n?>\r\n<i>one\r\n two</i>\r\n",
    "gate.php": b"<?php\n\nif (!allowed($user['role'])) {\n    exit;\n} else {\n    note(\"in\");\n}\n$label = 'n: ' . $count;\n",
    "inc/util.inc": b"<?php\nfunction twice(int $n = 1): int {\n\treturn 2 * $n;\n}\nclass Box extends Thing { public ?int $size = 3; static function make() { return new Box; } }\n",
    "menu.php": b"<nav>\n<?php foreach ($links as $url => $name): ?>\n  <a href=\"<?= $url ?>\"><?= $name ?></a>\n<?php endforeach; ?>\n</nav>\n",
    "open.php": b"<?php\necho 1;\nwhile ($more {\n  step();\n}\n?>\nrest",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for path, data in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    return root


def contents(out):
    return {str(p.relative_to(out)): p.read_bytes() for p in sorted(out.rglob("*")) if p.is_file()}


def test_tree_documents_and_manifest(spark, tree, tmp_path):
    out = tmp_path / "out"
    returned = extract_tree(spark, str(tree), str(out))
    m = json.loads((out / "manifest.json").read_text())
    assert returned == {k: v for k, v in m.items() if k != "files"} and sorted(p.name for p in out.iterdir()) == ["ast", "manifest.json"]
    assert [f["path"] for f in m["files"]] == sorted(FILES, key=os.fsencode)
    assert m["totals"]["files"] == 6 and m["totals"]["parseFailures"] == 1 and m["excluded"] == [] and m["extensions"] == [".inc", ".php"]
    for f in m["files"]:
        raw, written = FILES[f["path"]], (out / f["ast"]).read_bytes()
        doc = json.loads(written)
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] == doc["sha256"] and f["bytes"] == len(raw) and hashlib.sha256(written).hexdigest() == f["astSha256"]
        assert written.decode() == canonical(doc) + "\n" and doc["nodeCount"] == len(doc["nodes"]) == f["nodeCount"]
        assert all(n["id"].startswith(f["fileId"] + "#") for n in doc["nodes"])
        check_nesting(doc["nodes"], raw)
    body = {k: v for k, v in m.items() if k != "contentHash"}
    leaves = [hashlib.sha256(canonical(e).encode()).hexdigest() for e in m["files"]]  # fewer than a node of the hash tree holds
    root = hashlib.sha256("\n".join(leaves).encode()).hexdigest()
    assert m["contentHash"] == hashlib.sha256((canonical(body | {"files": root}) + "\n").encode()).hexdigest()
    assert (out / "manifest.json").read_text() == canonical(m, indent=1) + "\n"
    written = read_documents(spark, str(out))
    listed = spark.createDataFrame([(f["ast"], f["path"], f["sha256"], f["bytes"]) for f in m["files"]], "ast string, path string, sha256 string, bytes long")
    assert written.count() == 6 and checks.unlisted_files(listed, written).count() == 0 and checks.unlisted_files(listed.limit(5), written).count() == 1
    raw = read_tree(spark, str(tree)).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    assert checks.changed_bytes(listed, raw).count() == 0


def test_repeat_relocate_and_stale(spark, tree, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    extract_tree(spark, str(tree), str(a))
    moved = tmp_path / "elsewhere"
    os.rename(tree, moved)
    (b / "ast").mkdir(parents=True)
    (b / "ast" / "f999.json").write_text("old")
    (b / "other.txt").write_text("stays")
    extract_tree(spark, str(moved), str(b))
    got = contents(b)
    assert got.pop("other.txt") == b"stays" and got == contents(a)
    assert not any(str(tmp_path).encode() in x for x in got.values())
    before = json.loads(got["manifest.json"])["contentHash"]
    (moved / "gate.php").write_bytes(b"<?php echo 1;\n")
    assert extract_tree(spark, str(moved), str(b))["contentHash"] != before


def test_scan_corners(spark, tmp_path):
    root = tmp_path / "s"
    for name in (".h.php", "_u.php", "_d/z.php", "B.PHP", "x.inc", "a b.php", "é.php", "sub.x/1.php", "sub/1.php", "node_modules/m.php", "deep/node_modules/node_modules/n.php", "readme.txt", "empty.php"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.php" else b"<?php 1;")
    os.symlink(root / "x.inc", root / "link.php")
    os.symlink(root / "sub", root / "linked")
    os.symlink(root / "x.inc", root / "node_modules" / "link.inc")
    rows = read_tree(spark, str(root)).orderBy("file_ord").collect()
    expected = sorted([".h.php", "_u.php", "_d/z.php", "B.PHP", "x.inc", "a b.php", "é.php", "sub.x/1.php", "sub/1.php", "empty.php"], key=os.fsencode)
    assert [(r.file_ord, r.path) for r in rows] == list(enumerate(expected))
    hidden = [tuple(r) for r in read_tree(spark, str(root), table="excluded").collect()]
    assert hidden == [("deep/node_modules", 1), ("node_modules", 2)]
    assert read_tree(spark, str(root), extensions=("PHP",)).count() == 0 and normal_extensions(["php", ".x"]) == (".php", ".x")
    assert read_tree(spark, str(root), exclude=("sub",)).where("path like '%node_modules%'").count() == 3 - 1
    with pytest.raises(TreeError):
        read_tree(spark, str(root / "none"))
    many = tmp_path / "many"
    many.mkdir()
    for i in range(1001):
        (many / f"{i:04d}.php").write_bytes(b"")
    x = extract(read_tree(spark, str(many)))
    assert x.docs.agg(F.max("file_ord"), F.count("*")).first() == (1000, 1001) and x.docs.where("file_id = 'f1000'").count() == 1


def test_frame_scan(spark):
    paths = ["a/x.php", "a/vendor/y.PHP", "vendor/b/vendor/z.inc", "x.php", "vendor.php", "a/b.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in scan.discover(df, exclude=("vendor",)).collect()) == ["a/x.php", "vendor.php", "x.php"]
    assert sorted(map(tuple, scan.excluded(df, exclude=("vendor",)).collect())) == [("a/vendor", 1), ("vendor", 1)]
    names = spark.createDataFrame([(p,) for p in ("Z", "a", "é", "\uffee", "\U0001f600", "sub.x", "sub/x")], "path string").repartition(5)
    got = [r.path for r in scan.numbered(names).orderBy("file_ord").collect()]
    assert got == sorted(got, key=lambda s: s.encode()) and [r.file_ord for r in scan.numbered(names).orderBy("path").collect()] == list(range(7))


def test_golden_empty_file(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.php").write_bytes(b"")
    for pretty, expected in ((False, "752bf81d79e6cd2083570f3e4d4f725fd5ebf05676f355ddaea8d01724c53855"), (True, "d3fc519497a98d44a53f26e3f03d3da6fdeb788ba0bf549d2c7e55ffe3955077")):
        extract_tree(spark, str(tmp_path / "e"), str(tmp_path / "o"), pretty=pretty)
        assert [r.astSha256 for r in manifest_entries(spark, str(tmp_path / "o")).collect()] == [expected]
    (tmp_path / "e" / "empty.php").unlink()
    m = extract_tree(spark, str(tmp_path / "e"), str(tmp_path / "o"))
    assert m["totals"] == {"files": 0, "nodes": 0, "parseFailures": 0} and json.loads((tmp_path / "o" / "manifest.json").read_text()) == m | {"files": []}


def trees_of(spark, sources):
    """(nodes, errors) of each source, from one plan."""
    df = spark.createDataFrame([(i, f"{i}.php", x) for i, x in enumerate(sources)], "file_ord int, path string, content binary")
    rows = {r.file_ord: json.loads(r.ast_json) for r in extract(df).docs.select("file_ord", "ast_json").collect()}
    return [(rows[i]["nodes"], rows[i]["parseErrors"]) for i in range(len(sources))]


def kinds(nodes, data):
    return [(n["kind"], data[n["loc"]["startByte"] : n["loc"]["endByte"]].decode("latin-1")) for n in nodes]


def check_nesting(nodes, data):
    by_id = {n["id"]: n for n in nodes}
    starts = [0, *(i + 1 for i, b in enumerate(data) if b == 10)]
    assert len(by_id) == len(nodes) and [int(n["id"].split("#")[1]) for n in nodes] == list(range(len(nodes)))
    for n in nodes:
        loc = n["loc"]
        named = [x for v in n["fields"].values() for x in (v if isinstance(v, list) else [v]) if x]
        assert sorted(named) == n["children"] == sorted(n["children"]) and all(by_id[c]["parent"] == n["id"] and c > n["id"] for c in n["children"])
        assert loc["startCol"] == loc["startByte"] - starts[loc["startLine"] - 1] and loc["endCol"] == loc["endByte"] - starts[loc["endLine"] - 1]
        assert loc["startLine"] == 1 + data.count(b"\n", 0, loc["startByte"]) and loc["endLine"] == 1 + data.count(b"\n", 0, loc["endByte"])
        if n["parent"]:
            up = by_id[n["parent"]]
            assert n["id"] in up["children"] and up["loc"]["startByte"] <= loc["startByte"] < loc["endByte"] <= up["loc"]["endByte"]


def test_inline_html(spark):
    sources = [FILES["dos.php"], FILES["bytes.php"], FILES["menu.php"], b"\n\n", b"", b"a <?PHP echo '?>', /* ?> */ 1 // ?>b", b"x<?= 1 ?>\r\n\r\ny<?phpz"]
    found = [[(n["loc"]["startByte"], n["loc"]["endByte"], n["attrs"]["value"]) for n in nodes if n["kind"] == "Stmt_InlineHTML"] for nodes, errors in trees_of(spark, sources) if not errors]
    assert found[0] == [(0, 14, "<h1>top\r\n</h1>"), (42, 60, "<i>one\r\n two</i>\r\n")]
    assert found[1] == [(0, 3, "<p>"), (21, 32, {"__b64": base64.b64encode(b"na\xefve \xff</p>").decode()})]
    assert [v for _, _, v in found[2]] == ["<nav>\n", '  <a href="', '">', "</a>\n", "</nav>\n"]
    assert found[3] == [(0, 2, "\n\n")] and found[4] == [] and [v for _, _, v in found[5]] == ["a ", "b"] and [v for _, _, v in found[6]] == ["x", "\r\ny<?phpz"]


def test_syntax_roles(spark):
    data = FILES["gate.php"]
    (gate, errors), (util, _), (menu, _) = trees_of(spark, [data, FILES["inc/util.inc"], FILES["menu.php"]])
    by_id = {n["id"]: n for n in gate}
    (branch,) = [n for n in gate if n["kind"] == "Stmt_If"]
    assert not errors and sorted(branch["fields"]) == ["cond", "else", "elseifs", "stmts"] and branch["fields"]["elseifs"] == []
    assert by_id[branch["fields"]["cond"]]["kind"] == "Expr_BooleanNot" and by_id[branch["fields"]["else"]]["kind"] == "Stmt_Else"
    assert [by_id[x]["kind"] for x in branch["fields"]["stmts"]] == ["Stmt_Expression"] and sum(n["kind"] == "Expr_Exit" for n in gate) == 1
    text = data[branch["loc"]["startByte"] : branch["loc"]["endByte"]]
    assert text.startswith(b"if (!allowed") and text.endswith(b'note("in");\n}')
    assert ("Expr_BinaryOp_Concat", "'n: ' . $count") in kinds(gate, data) and ("Expr_ArrayDimFetch", "$user['role']") in kinds(gate, data)
    assert [(n["kind"], n["attrs"].get("name") or n["attrs"].get("signature")) for n in util if n["kind"] in ("Stmt_Function", "Stmt_Class")] == [("Stmt_Function", "twice"), ("Stmt_Class", "Box extends Thing"), ("Stmt_Function", "make")]
    (loop,) = [n for n in menu if n["kind"] == "Stmt_Foreach"]
    assert len(loop["fields"]["stmts"]) == 5 and sum(n["kind"] == "Stmt_Echo" for n in menu) == 2


def test_statements_and_chains(spark):
    data = b"""<?php
if ($a) b(); elseif ($c): d(); else: e(); endif;
switch ($x) { case 1: f(); break; default: g(); }
do { h(); } while ($i);
try { k(); } catch (A | B $e) { } finally { m(); }
for ($i = 0; $i < 3; $i++) { $r[] = match ($i) { 0, 1 => 'a', default => fn($z) => $z ** 2 }; }
#[Pure] abstract class T { use U { v as w; } const K = 1; }
goto end; end: $s = <<<X
    a $b
      c
    X;
$f = function () use (&$q) { return static fn() => yield; };
list(, [$u]) = [1, ...$w]; echo $o?->p['q']::R, (int) -$x ?: 0o17; unset($y);
"""
    data = data.replace(b"if ($a) b(); elseif ($c): d(); else: e(); endif;", b"if ($a): b(); elseif ($c): d(); else: e(); endif;")
    ((nodes, errors),) = trees_of(spark, [data])
    assert errors == []
    check_nesting(nodes, data)
    by_id = {n["id"]: n for n in nodes}
    top = [by_id[x]["kind"] for x in nodes[0]["children"]]
    assert top == ["Stmt_If", "Stmt_Switch", "Stmt_Do", "Stmt_TryCatch", "Stmt_For", "Stmt_Class", "Stmt_Goto", "Stmt_Label", "Stmt_Expression", "Stmt_Expression", "Stmt_Echo", "Stmt_Unset"]
    fields = {n["kind"]: n["fields"] for n in nodes}
    assert len(fields["Stmt_If"]["elseifs"]) == 1 and fields["Stmt_If"]["else"] and fields["Stmt_Do"]["while"] and len(fields["Stmt_TryCatch"]["catches"]) == 1 and fields["Stmt_TryCatch"]["finally"]
    cases = [n for n in nodes if n["kind"] == "Stmt_Case"]
    assert [len(n["fields"]["stmts"]) for n in cases] == [2, 1] and [n["fields"]["cond"] is None for n in cases] == [False, True]
    assert fields["Expr_List"]["items"][0] is None and len(fields["Expr_Match"]["arms"]) == 2
    assert [n["attrs"]["variables"] for n in nodes if n["kind"] == "Scalar_InterpolatedString"] == ["b"]
    assert [n["attrs"]["value"] for n in nodes if n["kind"] == "Scalar_Int"][-1] == 15


def test_scalars(spark):
    ((nodes, errors),) = trees_of(spark, [b"<?php $v = [1_0, 0x1F, 1e1000, 9223372036854775808, 1.0, '\xe9', \"\\x41\\u{e9}\\n\", ($c), \"\\u{10FFFF}\"];"])
    assert not errors
    assert [n["attrs"]["value"] for n in nodes if n["kind"].startswith("Scalar")] == [10, 31, {"__float": "INF"}, 9223372036854775808.0, 1.0, {"__b64": "6Q=="}, "A\u00e9\n", "\U0010ffff"]
    assert [n["attrs"].get("_parenthesized") for n in nodes if n["attrs"].get("name") == "c"] == [True]
    assert [n["attrs"]["_rawValue"] for n in nodes if "_rawValue" in n["attrs"]][:2] == ["1_0", "0x1F"]
    assert canonical([1e25, 1.0, 1e-5, -0.0, "\x1f\u2028/\u00e9"]) == '[1e+25,1.0,1e-05,-0.0,"\\u001f\u2028/\u00e9"]' and scalar(float("nan")) == {"__float": "NAN"}
    assert [number(x) for x in ("0x_", "0b_", "0", "017", "0o17", "0b11", "9" * 5000)] == [0, 0, 0, 15, 15, 3, float("inf")]
    assert unquoted(b'"\\u{D800}\\u{FFFFFFFF}"') == b"\xed\xa0\x80\\u{FFFFFFFF}" and unquoted(b"<<<'A'\n  x\\n\n    y\n  A") == b"x\\n\n  y"


def test_errors_are_data(spark):
    sources = [FILES["open.php"], b"<?php }", b"<?php " + b"(" * 5000, b"<?php a(); if (1) { echo 2", b"<?php a(); b($; c();", b"<?php $a" + b".$a" * 3000 + b";", b"<?php 'x", b"<?php " + b"-" * 500 + b"1;", b"<?php if (1): b(); }", b"<?php f(function() { 1 2; });"]
    found = trees_of(spark, sources)
    assert [bool(errors) for _, errors in found] == [True] * 5 + [False] + [True] * 4
    assert found[0][1] == [{"endLine": 3, "message": "unclosed '('", "startLine": 3}] and kinds(found[0][0], sources[0])[1:] == [("Stmt_Echo", "echo 1;"), ("Scalar_Int", "1"), ("Stmt_InlineHTML", "rest")]
    assert ("Name", "a") in kinds(found[3][0], sources[3]) and len(found[5][0]) > 6000
    names = [t for k, t in kinds(found[4][0], sources[4]) if k == "Name"]
    assert "a" in names
    assert [k for k, _ in kinds(found[9][0], sources[9])].count("Stmt_Invalid") == 1
    for (nodes, _), data in zip(found, sources):
        check_nesting(nodes, data)


def test_random_sources_nest(spark):
    rng = random.Random(4)
    tokens = [b"<?php ", b"?>\n", b"$a", b"(", b")", b"{", b"}", b"[", b"]", b"if", b"else", b"function", b"class", b";", b",", b"=>", b"->", b"::", b"'x'", b'"', b"1", b"+", b"match", b"case", b"switch", b"foreach", b" as ", b"fn", b"\xff", b":", b"endif", b"0x_", b"1e5", b'"\\u{D800}$a"', b"<<<A\n", b"\nA", b"#[", b"\\", b"do", b"while", b"else:"]
    sources = [b"<?php " + b" ".join(rng.choice(tokens) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    sources += [rng.randbytes(rng.randrange(60)) + b"<?php " + rng.randbytes(rng.randrange(60)) for _ in range(500)]
    for (nodes, _), data in zip(trees_of(spark, sources), sources):
        check_nesting(nodes, data)


def test_tables_and_checks(spark, tree):
    for parts in (1, 8):
        x = extract(read_tree(spark, str(tree)).repartition(parts))
        nodes, edges = x.nodes.cache(), x.edges.cache()
        found = [checks.broken_parents(nodes), checks.stray_children(nodes), checks.field_mismatches(nodes, edges), checks.repeated_ids(nodes), checks.unordered_children(nodes)]
        assert [df.count() for df in found] == [0] * 5
    bad = nodes.withColumn("parent_ord", F.when(F.col("node_ord") == 2, 99).otherwise(F.col("parent_ord")))
    assert checks.broken_parents(bad).count() > 0 and checks.stray_children(bad).count() > 0
    assert checks.repeated_ids(nodes.union(nodes.limit(1))).count() == 1
    x.views()
    assert spark.sql("select count(*) n from nodes where kind = 'Stmt_If'").first().n == 1
    assert lookup(read_tree(spark, str(tree)), "inc/util.inc").first().parse_ok and rollup.totals(x.files).first() == (6, nodes.count(), 1)
    diff = {r.path: r.status for r in checks.tree_diff(x.docs, x.docs.where("path <> 'gate.php'")).collect()}
    assert diff["gate.php"] == "left_only" and set(diff.values()) == {"left_only", "same"}


def test_dominance(spark):
    def warned(*sizes):
        return [r.top for r in rollup.dominance_warning(spark.createDataFrame([(p, n) for p, n in sizes], "path string, node_count int")).collect()]

    assert warned(("a/x", 5), ("b/x", 5)) == ["a"] and warned(("x", 5), ("b/x", 5)) == [] and warned(("a/x", 4), ("b/x", 5)) == ["b"] and warned(("a/x", 1), ("b/x", 1), ("c/x", 1)) == [] and warned() == []


def test_column_functions(spark):
    df = spark.createDataFrame([(7, b"ab\nc\xc3\xa9", [0, 3])], "n int, c binary, s array<int>")
    r = df.select(C.file_id(F.lit(12345)), C.node_id(F.lit("f001"), F.col("n")), C.last_line(F.col("c")), C.end_col(F.col("c")), C.line_start(F.col("s"), F.lit(2)), C.line_start(F.col("s"), F.lit(9)), C.is_file_id(F.lit("f01")), C.positive_or_null(F.lit(-1)), C.json_string(F.lit('a"\\\x1f\x0cé/'))).first()
    assert tuple(r) == ("f12345", "f001#00007", 2, 3, 3, 0, False, None, json.dumps('a"\\\x1f\x0cé/', ensure_ascii=False))


def test_failure_leaves_no_manifest(spark, tree, tmp_path):
    x = extract(read_tree(spark, str(tree)))
    broken = x.docs.withColumn("ast_json", F.when(F.col("file_ord") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("ast_json")).cast("string"))
    x.docs = broken
    with pytest.raises(Exception, match="no"):
        write_tree(x, str(tmp_path / "o"))
    assert not (tmp_path / "o" / "manifest.json").exists()


def test_command_line(spark, tree, tmp_path, capsys):
    (tree / "big").mkdir()
    (tree / "big" / "a.php").write_bytes(b"<?php " + b"$x = [1,2,3];\n" * 50)
    out = tmp_path / "o"
    assert cli.main([str(tree), "--out", str(out), "--exclude-dir", "inc"]) == 0
    said = capsys.readouterr()
    assert said.out.startswith("6 files, ") and "with parse errors ->" in said.out
    assert "excluded inc: 1 files" in said.err and "warning: big holds" in said.err and "parse errors in open.php: 1" in said.err
    assert cli.main([str(tree / "none"), "--out", str(out)]) == 1 and cli.main([]) == 2 and cli.main(["--version"]) == 0
    assert cli.main(["--file", str(tree / "gate.php"), "--file-id", "x1"]) == 2 and cli.main(["--file", str(tree / "nope.php")]) == 1
    capsys.readouterr()
    assert cli.main(["--file", str(tree / "gate.php"), "--file-id", "f007"]) == 0
    one = json.loads(capsys.readouterr().out)
    assert one["rootId"] == "f007#00000" and one == json.loads(canonical(extract_file(spark, str(tree / "gate.php"), "f007")))
    written = written_document(spark, str(out), "gate.php").first()
    assert json.loads(written.ast_json)["nodeCount"] == len(one["nodes"]) == written.nodeCount and manifest_entries(spark, str(out)).count() == 6
    broken = tree / "locked.php"
    os.mkdir(broken)
    os.symlink(tree / "none", broken / "x.php")
    assert cli.main([str(tree), "--out", str(tree / "gate.php" / "o")]) == 1 and "error: " in capsys.readouterr().err
