"""The filter audit, the language model and the token alignment against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from coppice.llm import filter_audit, language_model, token_alignment
from coppice.llm.mapped_arrays import Reader, Table, bits_for, packed, reduced, summed, unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


# --- filter audit ---------------------------------------------------------------------------------


def plain_audit(docs, labels):
    texts = [(i, t or "", p or "") for i, t, p in docs]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    seen = defaultdict(list)
    for i, t, p in texts:
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        seen[p].append((fails, any(q == 1 for d, q, _ in labels if d == i and d is not None), any(x == 1 for d, _, x in labels if d == i and d is not None)))
    out = {}
    for p, rows in seen.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                earlier = order[:step]
                here = [r for r in rows if r[0][x] and not any(r[0][e] for e in earlier)]
                shapley[x] += len(here)
                out[p, "".join(order), step + 1] = [
                    sum(not any(r[0][e] for e in (*earlier, x)) for r in rows), len(here), sum(r[0][x] and any(r[0][e] for e in earlier) for r in rows),
                    sum(r[0][x] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in here), sum(r[2] for r in here),
                ]
        for (part, order, step), v in out.items():
            if part == p:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_every_order_by_hand(spark):
    good = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, good, "en"), (2, good, "de"), (2, good, None), (3, None, None), (4, "", ""), (5, "#" * 3, "en"), (None, good, "en"), (6, "ABC " * 120, "en"), (7, "x $ " * 60, "de"), (8, good + " |", "en"), (8, good, "xx"),
        (9, "Wörter " * 200, "de"), (10, ("long" * 50_000 + " ") * 3 + good, "en"), (11, "a" * 300_000, "fr"), (12, "a" * 300_000, "fr"), (13, "AAAAAAAAAA" + "a" * 90, "fr"), (14, "AAAAAAAAAAA" + "a" * 89, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (None, 1, 1), (12, 1, None), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "s", 0) for d in docs], DOC).withColumnRenamed("source", "mask").withColumnRenamed("n_chars", "part")
    got = filter_audit.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.MEASURES] for r in got} == want
    assert len(got) == 600 * len({p or "" for _, _, p in docs})


def test_filter_audit_of_nothing_and_of_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], DOC), labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, "a", None, "s", 1)], DOC), labels)
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0


def test_shapley_values_share_out_what_fails(spark):
    """Over all orders each document that fails is removed once an order."""
    docs = spark.createDataFrame([(i, "a " * i + "#" * (i % 3), f"l{i % 2}", "s", 0) for i in range(1, 200)], DOC)
    got = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).toPandas()
    per = got[got["filter_order"] == "ABCDE"].groupby("part")["shapley"].sum()
    kept = got[(got["filter_order"] == "ABCDE") & (got["step"] == 5)].set_index("part")["kept"]
    sizes = pd.Series({"l0": 99, "l1": 100})
    assert (per == 120 * (sizes - kept)).all()


# --- mapped arrays --------------------------------------------------------------------------------


def test_mapped_arrays_find_what_tasks_wrote(spark, tmp_path):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    table = Table(str(tmp_path), "t", 3, [("a", "<i8"), ("b", "<u4")])
    import pyarrow as pa

    rows = [(int(k) >> 61, packed(keys[keys >> np.uint64(61) == np.uint64(k >> np.uint64(61))])) for k in keys[np.unique(keys >> np.uint64(61), return_index=True)[1]]]
    given = spark.createDataFrame([(s, b) for s, b in rows], "shard int, data binary")

    def write(shard, own):
        k = np.sort(np.concatenate([unpacked(r["data"], np.uint64) for r in own]))
        table.write(shard, k, k.astype(np.int64) % 1000, k % np.uint64(7))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "entries": len(k)}], pa.schema([("shard", pa.int32()), ("entries", pa.int64())]))

    for _ in range(2):  # a second attempt puts the same files in place
        sizes = reduced(given, table.shards, write, "shard int, entries long").collect()
    reader = Reader(table.of([(r.shard, r.entries) for r in sizes]))
    asked = rng.permutation(np.concatenate([keys, keys + np.uint64(1), keys[:10]]))
    place, a, b = reader.find(asked)
    there = asked % np.uint64(2) == 0
    assert (place[~there] == -1).all() and (a[~there] == 0).all()
    assert (keys[place[there]] == asked[there]).all() and (a[there] == asked[there].astype(np.int64) % 1000).all() and (b[there] == asked[there] % np.uint64(7)).all()


def test_sums_over_equal_keys_and_shards_by_size():
    places, n, m = summed(np.array([5, 3, 5, 5], np.uint64), np.array([1, 2, 3, 4]), np.array([True, False, True, False]))
    assert places.tolist() == [1, 0] and n.tolist() == [2, 8] and m.tolist() == [0, 2]
    assert [len(x) for x in summed(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [0, 0]
    assert bits_for(0) == 1 and bits_for(1 << 30) == 9


# --- language model -------------------------------------------------------------------------------


class PlainModel:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.levels = order, []
        self.unigrams = Counter(t for x in texts for t in x)
        grams = Counter(g for x in texts for g in self.ngrams(x))
        for k in range(order, 0, -1):
            seen = Counter(grams.values())
            n = [seen[c] for c in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
            d = []
            for c, other in ((1, 0.5), (2, 1.0), (3, 1.5)):
                x = c - (c + 1) * y * n[c] / n[c - 1] if n[c - 1] else 0
                d.append(x if 0 < x < c else other)
            behind = defaultdict(list)
            for g, c in grams.items():
                behind[g[:-1]].append(c)
            self.levels.insert(0, (grams, d, behind))
            grams = Counter(g[1:] for g in grams)

    def ngrams(self, tokens):
        line = ["<s>"] * (self.order - 1) + tokens
        return [tuple(line[i : i + self.order]) for i in range(len(tokens))]

    def p(self, gram):
        if not gram:
            return 1 / (len(self.unigrams) + 1)
        grams, d, behind = self.levels[len(gram) - 1]
        counts = behind.get(gram[:-1], [])
        low = self.p(gram[1:])
        if not counts:
            return low
        total, c = sum(counts), grams.get(gram, 0)
        left = sum(d[min(x, 3) - 1] for x in counts)
        return ((c - d[min(c, 3) - 1]) if c else 0) / total + left / total * low


def tokens_of(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + ["\n"]


def learned(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def small_corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"W{int(x)}" if x % 3 else f"é{int(x)}" for x in range(60)]
    return [(i, " ".join(words[int(x) % 60] for x in rng.zipf(1.3, rng.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_its_definition(spark, order):
    docs = small_corpus(150) + [(None, "W1 w2 new"), (900, None), (901, ""), (902, "W1\tW2\nw1 " * 40), (902, "W1"), (903, "x" * 200_000 + " W1 " + "y" * 140_000), (904, "x" * 200_000 + " unseen")]
    frame = spark.createDataFrame([(i, t, "s", "held", 3) for i, t in docs], "doc_id long, text string, role string, held_out string, shard int")
    got = sorted(language_model.scored(frame, order).toPandas().fillna({"doc_id": -1}).itertuples(index=False), key=lambda r: (r.doc_id, r.n_tokens))
    model = PlainModel([tokens_of(t) for i, t in docs if learned(i)], order)
    train = sum(model.unigrams.values())
    want = []
    for i, t in docs:
        toks = tokens_of(t)
        base = sum(math.log10((model.unigrams[x] + 1) / (train + len(model.unigrams) + 1)) for x in toks)
        want.append((-1 if i is None else i, not learned(i), len(toks), sum(model.unigrams[x] > 0 for x in toks), train, base, sum(math.log10(model.p(g)) for g in model.ngrams(toks))))
    want.sort(key=lambda r: (r[0], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    model = PlainModel([tokens_of(t) for _, t in small_corpus(80)], 3)
    outcomes = [*model.unigrams, "never"]
    for context in (("w1", "w2"), ("<s>", "<s>"), ("never", "w1"), ("w1", "never")):
        assert sum(model.p((*context, x)) for x in outcomes) == pytest.approx(1)


def test_language_model_of_little(spark):
    """Nothing to learn from, counts without a count of 1, and no rows."""
    out = next(i for i in range(99) if not learned(i))
    kept = next(i for i in range(99) if learned(i))
    one = language_model.scored(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)
    same = language_model.scored(spark.createDataFrame([(kept, "a a a a"), (kept, "a a a a"), (out, "b")], "doc_id long, text string")).collect()
    model = PlainModel([tokens_of("a a a a")] * 2, 2)
    for r in same:
        text = "b" if r.held_out else "a a a a"
        assert r.score == pytest.approx(sum(math.log10(model.p(g)) for g in model.ngrams(tokens_of(text))))
    assert language_model.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- token alignment ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return token_alignment.Tokenizers(public_tokenizers.path(token_alignment.TOKENIZER_A), public_tokenizers.path(token_alignment.TOKENIZER_B))


def plain_tokens(tokenizers, text):
    """[(id, first byte, byte behind)] of both tokenizers over the whole text; nothing where they don't spell it."""
    if not text:
        return [], []
    a, b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
    out = []
    for ids, table in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        at, placed = 0, []
        for i in ids:
            placed.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(placed)
    return out


def plain_alignment(tokenizers, texts):
    placed, links, counts = [plain_tokens(tokenizers, t) for t in texts], [], Counter()
    for a, b in placed:
        own, j = [], 0
        for x, s, e in a:  # a sweep over both, not the operator's arrays
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                own.append((x, b[k][0]))
                k += 1
        links.append(own)
        counts.update(own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for (a, b), own in zip(placed, links, strict=True):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and a[i][2] <= c:
                ga.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= c:
                gb.append(str(b[j][0]))
                j += 1
            parts.append(",".join(ga) + "|" + ",".join(gb))
        groups = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        out.append((len(a), len(b), len(cuts), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), groups))
    return out


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "\ta\t\tb", "it's they'll 'd", "x\u00a0y", "x\u3000y z", "\u2581", "a \u2581b", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01 \x1c x!\x1c y",
    "Äöü ßé", "日本語 の テスト", "😀 👩‍👩‍👧 x", "e\u0301 ﬁ １２", "\r\n a\r", "foo.\nBar baz\n", "1234567 12 3", "\u0085 a\u2028b", "a\u200bb", "\ufeffa", "a" * 3000, "ab " * 2000, "!?." * 500,
]


def test_stretches_are_tokenized_as_in_their_text(tokenizers):
    rng = np.random.default_rng(3)
    alphabet = [" ", " ", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\u00a0", "\u3000", "\u200b", "\u180e", "a", "the", "Z", "1", "!", ".", "'s", "'", "é", "日", "😀", "\x00", "_", "<s>", "<|endoftext|>", "\u0301", "ﬁ"]
    texts = [t for t in ODD if t and "\u2581" not in t] + ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(1, 40))) for _ in range(4000)]
    for text in texts:
        split = token_alignment.STRETCH.findall(" " + text)
        assert "".join(split) == " " + text
        a, b = tokenizers.encode(split)
        assert [i for x in a for i in x] == tokenizers.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for x in b for i in x] == tokenizers.b.encode(text), repr(text)


def test_token_alignment_equals_a_sweep(spark, tokenizers):
    texts = ODD + ["the cat sat on the mat's edge", "the cat", "the cat"] + [t for _, t in small_corpus(40)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, links string, n string").repartition(3)
    got = rows_of(token_alignment.aligned(frame), ["doc_id"])
    want = plain_alignment(tokenizers, texts)
    for i, w in enumerate(want):
        g = got[(i,)]
        assert tuple(g[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == w, repr(texts[i])[:80]


def test_token_alignment_forgets_stretches_and_sends_sums_on(spark, tokenizers, monkeypatch):
    """With bounds of a few stretches and pairs the results are the same."""
    monkeypatch.setattr(token_alignment, "MOST_STRETCHES", 5)
    aligner = token_alignment.Aligner(tokenizers)
    texts = [t for _, t in small_corpus(30)]
    want = plain_alignment(tokenizers, texts)
    for t, w in zip(texts, want, strict=True):
        counts, written, pairs, times = next(aligner.align([t]))
        assert tuple(counts) == w[:4] and (hashlib.sha256(written.encode()).hexdigest() if written else "") == w[6] and times.sum() == w[3]


def test_token_alignment_of_nothing(spark):
    assert token_alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = token_alignment.aligned(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in rows) == [(0, 0, 0, "")] * 2
