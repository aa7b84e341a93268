"""Joins over trees and places, numbering, hash trees and reconciliation against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import checks, hash_tree, places, scan, structural, walk
from coppice.plans.extract import lookup, under
from coppice.plans.tree import read_tree
from coppice.sources.php_tree import TreeReader


def random_tree(rng, n):
    """(node_ord, subtree_end, kind) of a random tree of n nodes in pre-order."""
    parents = [None] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
    # Only places on the path to the last node keep pre-order.
    path, rows = [0], [[0, n, "a"]]
    for i in range(1, n):
        while path and path[-1] > parents[i] and len(path) > 1:
            rows[path.pop()][1] = i
        rows.append([i, n, rng.choice("abc")])
        path.append(i)
    for x in path:
        rows[x][1] = n
    return rows


def test_contained_finds_every_pair(spark):
    rng = random.Random(2)
    files = {f: random_tree(rng, rng.randrange(1, 60)) for f in range(25)} | {99: [[i, 200, "a" if i % 2 else "b"] for i in range(200)]}
    nodes = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows] + [(None, 0, 1, "a"), (3, None, None, "a")], "file_ord long, node_ord int, subtree_end int, kind string").repartition(5)
    for inner, outer in (("a", "b"), ("a", "a"), ("c", "ab")):
        want = set()
        for f, rows in files.items():
            outers = [r for r in rows if r[2] in outer]
            for n, _, k in rows:
                if k in inner:
                    over = [o for o in outers if o[0] < n < o[1]]
                    want |= {(f, o[0], n, sum(o[0] < p[0] for p in over)) for o in over}
        got = structural.contained(nodes, F.col("kind").isin(*inner), F.col("kind").isin(*outer)).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("span", [3, 50, 1 << 16])
def test_places_get_their_lines(spark, span):
    rng = random.Random(span)
    files = {f"f{i}": bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(300))) for i in range(20)} | {None: b"x\n\ny", "long": b"z" * 400 + b"\n" + b"z" * 400, "": b""}
    lines = scan.line_starts(spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary"))
    asked = [(p, rng.randrange(len(c) + 1), n) for p, c in files.items() for n in range(15)] + [("f0", None, 1), ("none", 3, 1), ("f1", -1, 2)]
    got = places.located(spark.createDataFrame(asked, "path string, byte int, line_wanted int").repartition(4), lines, span).collect()
    want = []
    for p, b, n in asked:
        here = files.get(p) if b is not None and b >= 0 else None
        want.append((p, b, n, *((here.count(b"\n", 0, b) + 1, b - (here.rfind(b"\n", 0, b) + 1)) if here is not None else (None, None))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_every_row_has_a_number(spark):
    rows = [("b", b"1"), ("b", b"1"), ("b", b"2"), ("a", b"9"), (None, b"n"), (None, b"n"), ("c", None), ("é", b"")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), i) for i, (p, c) in enumerate(rows)], "path string, content binary, id int")
    got = {r.id: r for r in scan.with_ids(df).collect()}
    assert len(got) == 8 and sorted(r.file_ord for r in got.values()) == list(range(8))
    in_order = [got[i].path for i in sorted(got, key=lambda i: got[i].file_ord)]
    assert in_order == [None, None, "a", "b", "b", "b", "c", "é"]
    assert all(rows[i][1] == (None if r.content is None else bytes(r.content)) for i, r in got.items()) and got[3].file_id == "f002"
    assert sorted(r.file_ord for r in scan.with_ids(df.select("path")).collect()) == list(range(8))
    assert scan.with_ids(df.limit(0)).count() == 0
    lines = scan.line_starts(spark.createDataFrame([("p", bytearray(b"a\nb")), ("p", bytearray(b"\n")), ("q", None)], "path string, content binary"))
    assert sorted(map(tuple, lines.collect())) == [("p", 1, 0), ("p", 1, 0), ("p", 2, 1), ("p", 2, 2)]


def plain_root(digests, fan):
    if not digests:
        return hashlib.sha256(b"").hexdigest()
    while len(digests) > 1:
        digests = [hashlib.sha256("\n".join(digests[i : i + fan]).encode()).hexdigest() for i in range(0, len(digests), fan)]
    return digests[0]


def test_hash_tree(spark):
    for n, fan in ((0, 3), (1, 3), (3, 3), (4, 3), (100, 3), (1000, 10)):
        digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame(list(enumerate(digests)), "pos long, digest string").repartition(3)
        assert hash_tree.root_of(df, fan).first().digest == plain_root(digests, fan)
        if n > 1:
            assert hash_tree.root_of(df.withColumn("digest", F.when(F.col("pos") == n - 1, "x").otherwise(F.col("digest"))), fan).first().digest != plain_root(digests, fan)


def test_reconciled_equals_the_full_comparison(spark):
    rng = random.Random(1)
    a = [(f"p{i}", str(i)) for i in range(300)] + [(None, "n"), ("null", None)]
    b = [(p if rng.random() > 0.05 else f"{p}-moved", v if rng.random() > 0.05 else "x") for p, v in a]
    left, right = (spark.createDataFrame(x, "path string, ast_sha256 string") for x in (a, b))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for ranges in (1, 16, 4096):
        assert rows(checks.reconciled(left, right, ranges=ranges)) == rows(checks.tree_diff(left, right))
    assert {r.status for r in checks.reconciled(left, left.where("path is not null")).where("path is not null").collect()} == {"same"}
    assert checks.reconciled(left.limit(0), right.limit(0)).count() == 0


def test_filters_on_paths_reach_the_reader(spark, tmp_path):
    for name in ("a/x.php", "a/y.php", "b/z.php"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"<?php {name[0]}();")
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = TreeReader({"path": str(tmp_path)})
    other = GreaterThan(("file_ord",), 0)
    assert list(reader.pushFilters([EqualTo(("path",), "a/y.php"), other])) == [other]
    assert [p.files for p in reader.partitions()] == [[(1, "a/y.php")]]
    reader = TreeReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([StringStartsWith(("path",), "a/")])) == []
    assert [p.files for p in reader.partitions()] == [[(0, "a/x.php"), (1, "a/y.php")]]
    tree = read_tree(spark, str(tmp_path))
    scans = tree.where("path = 'a/y.php'")
    assert "a/y.php" not in scans._jdf.queryExecution().executedPlan().toString()  # no filter is left to Spark
    assert [r.file_id for r in lookup(tree, "a/y.php").collect()] == ["f001"]
    assert sorted(r.path for r in under(tree, "a/").select("path").collect()) == ["a/x.php", "a/y.php"]


def test_walk_by_rounds_equals_the_reader(spark, tmp_path):
    root = tmp_path / "s"
    names = (".h.php", "_d/z.php", "B.PHP", "x.inc", "a b.php", "é.php", "sub.x/1.php", "sub/1.php", "node_modules/m.php", "node_modules/deep/q.inc", "deep/node_modules/node_modules/n.php", "deep/er/and/er/w.php", "readme.txt", "empty.php", ".git/only.txt")
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.php" else name.encode())
    (root / "link.php").symlink_to(root / "x.inc")
    (root / "linked").symlink_to(root / "sub")
    (root / "node_modules" / "l.php").symlink_to(root / "gone")
    (root / "void").mkdir()
    files, hidden = walk.walked(spark, str(root))
    want = read_tree(spark, str(root))
    rows = lambda df: sorted((r.file_ord, r.path, bytes(r.content)) for r in df.collect())
    assert rows(walk.read_walked(files, str(root))) == rows(want)
    assert {(r.dir, r.files) for r in hidden.collect()} == {(r.dir, r.files) for r in read_tree(spark, str(root), table="excluded").collect()} == {("node_modules", 3), ("deep/node_modules", 1)}
    nothing, _ = walk.walked(spark, str(root / "void"))
    assert nothing.count() == 0 and walk.read_walked(nothing, str(root / "void")).count() == 0


def test_children_must_ascend(spark):
    children = {0: (1, 4, 2, 3), 1: (2, 3), 2: (2,), 3: (1, 2), 4: (5, 5), 5: (), 6: (99999, 100000, 7), 7: (9,)}
    nodes = spark.createDataFrame([(f, n, [f"f{f:03d}#{c:05d}" for c in kids]) for f in (0, 1) for n, kids in children.items()], "file_ord long, node_ord int, children array<string>")
    got = sorted((r.node_ord, r.child) for r in checks.unordered_children(nodes.repartition(3)).where("file_ord = 1").collect())
    assert got == [(0, 2), (2, 2), (3, 1), (3, 2), (4, 5), (6, 7)]
