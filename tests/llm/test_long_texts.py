"""Texts above a slice and words above a piece, against plain Python: the paths that only long inputs take."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coppice.llm import mixing, ngram_join, packing, quality_rules, rule_ensemble, sharding
from coppice.llm.shared import SLICE_BYTES
from coppice.llm.words import PIECE, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Ab#é" * (PIECE // 4)  # more bytes than a piece
TEXT = " ".join(f"w{i % 5000}" for i in range(120_000)) + "\n" + LONG + "\n" + " ".join(["x y z"] * 2000) + "\n" + LONG
DOCS = [(1, TEXT), (2, TEXT + " more"), (3, LONG + "x " + TEXT), (4, LONG), (5, LONG + "y"), (6, "a b c"), (7, "q " * 400_000)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(TEXT.encode()) > SLICE_BYTES and len(LONG.encode()) > PIECE
    return spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, len(t)) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars int").repartition(2).cache()


def plain_statistics(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated.update((i, i + 1, i + 2))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated)


def test_hashes_of_long_words_depend_on_the_word_alone():
    places = [0, 1, 7, PIECE - 3, PIECE - 1, PIECE, PIECE + 5]
    texts = ["z" * n + " " * bool(n) + LONG + " tail" for n in places]
    words = Words(pa.array(texts, pa.large_string()))
    hashes = words.hashes()
    own = {bytes(words.data[a:b]): h for a, b, h in zip(words.starts, words.ends, hashes, strict=True)}
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)] == [w for t in texts for w in WORD.findall(t)]
    assert all(own[bytes(words.data[a:b])] == h for a, b, h in zip(words.starts, words.ends, hashes, strict=True))
    assert len(set(own.values())) == len(own)
    changed = Words(pa.array([LONG[:-1] + "X", LONG, "X" + LONG[1:], LONG + "b"], pa.large_string())).hashes()
    assert len(set(changed.tolist())) == 4


def test_statistics_of_long_texts(docs):
    got = {r.doc_id: r for r in quality_rules.quality_table(docs).collect()}
    for i, text in DOCS:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == plain_statistics(text), i


def test_links_of_long_texts(docs):
    got = {r.doc_id: r for r in ngram_join.ngram_components(docs, width=3, percent=90).collect()}
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, text in DOCS:
        words = [w.translate(low) for w in WORD.findall(text)]
        sets[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or {tuple(words)}
        assert got[i].n_shingles == len(sets[i]), i
    linked = {(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    for a in sets:
        assert got[a].component_id == min(b for b in sets if (a, b) in linked), a  # no chains here


def test_sizes_of_long_texts(docs):
    sizes = {r.doc_id: r.size for r in mixing.mix_plan(docs).collect()}
    shards = {r.doc_id: r for r in sharding.sharded(docs).collect()}
    for i, text in DOCS:
        assert sizes[i] == len(WORD.findall(text))
        assert (shards[i].size, shards[i].text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))


def test_pieces_of_long_texts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.packed(docs).collect()
    for i, text in DOCS:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.CLOSING_ID], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_scores_of_long_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in DOCS], "doc_id long, quality int, toxic int")
    got = rule_ensemble.scored(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_training_rows_do_not_depend_on_the_partitions(spark):
    """An id with several texts trains with the same one in any order."""
    rows = [(i % 40, f"{'good words here ' * (i % 7 + 1)} {'#' * (i % 5)} {i}", "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    one = spark.createDataFrame(rows, schema).repartition(1)
    two = spark.createDataFrame(rows[::-1], schema).repartition(5)
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in rule_ensemble.scored(df, labels).collect()) for df in (one, two)]
    assert scores[0] == scores[1]
