"""Stretches, their maps of modes, and tokens that are the same however a file is cut."""

import itertools
import time

import numpy as np
import pytest

from coppice.functions.automaton import MODES, Stretch, cuts
from coppice.operators import lexing
from coppice.plans.extract import Look, extract

ODD = [
    b"", b"text only", b"<?php", b"<?php\n", b"a <?= $x ?>\n b <?php f(); ?>\r\n<?php\ng();", b"<?php $a = 'x;\n\\'y;\n' . \"p;\n\\\"q\" ; // c; ?> t\n<?php # d;\n/* e;\n ?> f */ g;\n",
    b"<?php $h = <<<A\n A1\n B;\nA1;\n  A;\n$n = <<<'B'\n;\n;\nB\n;", b'<?php $s = "{$a["k;\n"]} ${b[\'}\n;\']} {$c->{"d"}} {{$e}}";\n$t = `x {$y["`;\n"]}`;', b"<?php // last", b"<?php /* open;\n;", b"<?php 'open;\n;", b"<?php <<<X\n;\nXY\n",
    b"<?php use C\\{D, E as F}; \\A\\B\\c(); 1.5e3; 0x1F; .5; 1..2; $$v; #[A(1;2)]\nfn() => 1;", b"\xff\xfe<?php \xe9\xe9\n;'\xe9';\n", b"<?php ?>\n\n<?php ;\n?>", b"<?php <<<A\nA", b"<?php \"{$a}\n;{$b['\n;']}\"", b'<?php "\\', b"<?php '\\",
]


def random_script(rng):
    parts = [b"'", b'"', b"`", b"\\", b"\n", b";", b"{$", b"${", b"{", b"}", b"/*", b"*/", b"//", b"#", b"?>", b"<?php ", b"<?=", b"<<<A\n", b"<<<'A'\n", b"\nA", b"  A;", b"a", b"$v", b"1", b" ", b"\r\n", b"(", b")"]
    return b"<?php " * int(rng.integers(0, 2)) + b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 60)))


def whole_tokens(data):
    """(start, end, type) of the tokens of a file taken as one stretch, with what is never closed as open."""
    return [(a, b, "open" if after != "code" and (t == "str" or after == "block") else t) for a, b, t, _, after in Stretch(data, True).tokens("gap", True)]


def cut_tokens(data, size):
    """The same by way of stretches: maps composed, tokens of each, pieces put together."""
    out, mode, at = [], "gap", 0
    ends = cuts(data, size)
    for end in ends:
        stretch = Stretch(data[at:end], at == 0 or data[at - 1 : at] == b"\n")
        for a, b, t, begins, after in stretch.tokens(mode, at == 0):
            if begins:
                out.append([at + a, at + b, t, after])
            else:
                out[-1][1], out[-1][3] = at + b, after
        mode = stretch.effects().get(mode, mode)
        at = end
    assert ends[-1] == len(data) and all(a < b for a, b in itertools.pairwise(ends))
    return [(a, b, "open" if after != "code" and (t == "str" or after == "block") else t) for a, b, t, after in out]


def merged_space(tokens):
    """Space and comments that meet count as one: a cut may part them."""
    out = []
    for a, b, t in tokens:
        if out and t == out[-1][2] == "skip" and out[-1][1] == a:
            out[-1] = (out[-1][0], b, t)
        else:
            out.append((a, b, t))
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_tokens_do_not_depend_on_the_cuts(size):
    rng = np.random.default_rng(size)
    for data in ODD + [random_script(rng) for _ in range(1500)]:
        assert merged_space(cut_tokens(data, size)) == merged_space(whole_tokens(data)), data
        joined = b"".join(data[a:b] for a, b, _ in whole_tokens(data))
        assert joined == data


def test_maps_compose():
    """The map of two neighbours is the map of what they make together."""
    rng = np.random.default_rng(9)
    for _ in range(400):
        data = random_script(rng) + random_script(rng)
        for end in cuts(data, 5)[:-1]:
            fresh = data[end - 1 : end] == b"\n"
            left, right, both = Stretch(data[:end], True).effects(), Stretch(data[end:], fresh).effects(), Stretch(data, True).effects()
            for mode in (*MODES, "doc A", "doc none"):
                middle = left.get(mode, mode)
                assert right.get(middle, middle) == both.get(mode, mode), (data, end, mode)


@pytest.mark.parametrize("unit", [b"\\'", b"'", b'"', b"`", b"/*", b"<<<A\n", b"<<<A", b"{$", b'"{$', b"?>", b"<?php ", b"//", b"#", b"\\", b"0", b"1.", b"a", b"\\a", b"<", b'"{', b"\nA", b"'\\"])
def test_a_megabyte_of_anything_takes_seconds(unit):
    for opening in (b"", b"<<<A\n"):
        data = b"<?php " + opening + unit * ((1 << 20) // len(unit))
        began = time.perf_counter()
        tokens = Stretch(data, True).tokens("gap", True)
        assert tokens[-1][1] == len(data)
        for end in cuts(data, 1 << 16)[:: 1 if not opening else 8]:
            Stretch(data[max(0, end - (1 << 16)) : end], True).effects()
        assert time.perf_counter() - began < 20


def test_token_rows_are_the_same_for_any_size(spark):
    rng = np.random.default_rng(4)
    files = [*ODD, *(random_script(rng) for _ in range(60))]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "file_ord long, content binary").repartition(3)
    rows = lambda **how: sorted(map(tuple, lexing.tokens(df, **how).collect()))
    want = rows(large=False)
    assert want == rows(size=11) == rows(size=40)
    for n, data in enumerate(files):
        got = [r for r in want if r[0] == n]
        for r in got:
            start, line, line_start, end, end_line, end_line_start = r[5:]
            assert line == data[:start].count(b"\n") + 1 and line_start == data.rfind(b"\n", 0, start) + 1
            assert end_line == data[:end].count(b"\n") + 1 and end_line_start == data.rfind(b"\n", 0, end) + 1
        assert [(r[5], r[8], r[1]) for r in sorted(got, key=lambda r: (r[5], r[8]))] == [t for t in whole_tokens(data) if t[2] != "skip"]


@pytest.mark.parametrize("unit", [b"<<<A\n", b"\\'", b"'\\'", b'"{$', b"/*", b"`"])
def test_unclosed_openers_are_errors_of_one_file(spark, unit):
    bad = b"<?php a(); '" + unit * (200_000 // len(unit))
    df = spark.createDataFrame([(0, "bad.php", bytearray(bad)), (1, "good.php", bytearray(b"<?php a();"))], "file_ord long, path string, content binary")
    began = time.perf_counter()
    docs = {r.file_ord: r for r in extract(df, look=Look(True, False)).docs.select("file_ord", "parse_ok", "node_count", "parse_errors").collect()}
    assert time.perf_counter() - began < 60
    assert docs[1].parse_ok
    if not docs[0].parse_ok:
        assert docs[0].parse_errors[0].startLine == 1


def test_a_large_file_in_stretches_gives_the_same_document(spark):
    script = b"<html>\n<?php\nfunction f($a) {\n  /* one;\n two */ return \"x {$a[\"k\"]};\n\";\n}\n?>\ntext;\n" * 4000
    df = spark.createDataFrame([(0, "a.php", bytearray(script)), (1, "b.php", bytearray(b"<?php f();"))], "file_ord long, path string, content binary")
    one = {r.path: r.ast_sha256 for r in extract(df, look=Look(True, False)).docs.select("path", "ast_sha256").collect()}
    assert len(script) > lexing.STRETCH_BYTES
    assert one == {r.path: r.ast_sha256 for r in extract(df).docs.select("path", "ast_sha256").collect()}
