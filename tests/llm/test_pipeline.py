"""The pipeline stage by stage against plain Python, and as a whole."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from test_ops import brute_components, words

import corpus_pipeline
from coppice.llm import mixing, packing, pii, quality_rules, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, row string, node string, size string"


def corpus():
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(60, 300), 900) + "." for _ in range(40)]
    near = words(rng, 200, 9000).split()
    for k in range(8):
        copy = list(near)
        copy[5 * k] = f"y{k}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 4 + [f"{words(rng, 90)} write to a{k}@b.example.org or +1 (555) 010-{k}234 {words(rng, 30)}" for k in range(4)]
    texts += ["$$ ## " * 60, "too short", "", None, "same line of words here\n" * 100, words(rng, 9000, 9000)]
    return [(i if i % 23 or not i else None, t, "en", [None, "a", "b", "b", "b"][i % 5], len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, each made from its predecessor's as they were written."""
    docs = spark.createDataFrame(corpus(), COLUMNS).repartition(3)
    docs = docs.union(docs.where("doc_id = 1"))
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "none").cache()
        out.append(docs)
    return out


def by_text(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_stage(stages):
    verdict = collections.Counter((r.doc_id, r.word_chars, r.n_words) for r in quality_rules.quality_table(stages[0]).collect() if r.kept)
    kept = collections.Counter((i, sum(map(len, WORD.findall(t))), len(WORD.findall(t))) for (i, t), n in by_text(stages[1]).items() for _ in range(n))
    assert kept == verdict and set(range(2, 23)) <= {i for i, _, _ in kept}
    assert not any(t in ("too short", "", None) or t.startswith(("$$", "same line")) for _, t in by_text(stages[1]))


def test_near_duplicate_stage(stages):
    rows = sorted(set(by_text(stages[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    component = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    expected = {rows[k] for k, (_, c) in component.items() if c == k}
    got = by_text(stages[2])
    assert set(got) == expected and set(got.values()) == {1} and len(expected) < len(rows)


def test_personal_data_stage(stages):
    expected = collections.Counter()
    for (i, t), n in by_text(stages[2]).items():
        base, more = pii.find_spans(t)
        expected[i, spans.masked(t, base + more)] += n
    got = by_text(stages[3])
    assert got == expected and sum("<EMAIL>" in t and "<PHONE>" in t for _, t in got) == 4


def test_mixing_stage(stages):
    taken, given = collections.Counter(), collections.defaultdict(list)
    for r in mixing.mix_plan(stages[3]).collect():
        taken[r.source] += r.taken
    for r in stages[3].collect():
        given[r.doc_id, r.source].append(r.text)
    mixed = collections.Counter()
    for r in stages[4].collect():
        mixed[r.source] += len(WORD.findall(r.text))
        assert any(t.startswith(r.text) for t in given[r.doc_id, r.source])
    assert mixed == +taken


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    expected = collections.Counter()
    for r in stages[4].collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            expected[r.doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    pieces = stages[5].collect()
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == expected
    held = collections.defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_on_written_tables(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "none")
        assert docs.count() == 0
