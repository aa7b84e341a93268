"""What models and added spans say, recomputed by plain code of another shape."""

import base64
import math
import random
import re

import pytest

from coppice.llm import pii, quality_rules, secrets

FILLER = ["alpha", "beta", "gamma", "delta", "river", "stone", "green", "house"]


# --- quality rules: EM a document at a time ---------------------------------------------------------


def votes_of(s):
    """Each rule's vote, -1, 0 or 1, from a row of statistics."""
    per = lambda a, b: a / b if b else 0.0
    words, chars = s["n_words"], s["word_chars"]
    out = [-1 if words < 50 else 1 if words >= 80 else 0]
    for value, bad, good in (
        (per(s["n_repeat_words"], words), 0.3, 0.1), (per(s["n_symbols"], words), 0.1, 0.02), (per(s["n_symbols"], chars), 0.05, 0.005), (per(s["n_marks"], chars), 0.2, 0.1),
        (per(s["n_upper"], s["n_letters"]), 0.3, 0.12), (per(s["n_exclaim"], words), 0.1, 0.02),
    ):
        out.append(-1 if value > bad else 1 if value < good else 0)
    length = per(chars, words)
    out.append(-1 if length < 2 or length > 14 else 1 if 3 <= length <= 10 else 0)
    copies = per(s["n_dup_lines"], s["n_lines"])
    out.append(-1 if copies > 0.3 else 1 if copies < 0.05 else 0)
    top = per(s["n_top_word"], words)
    out.append(-1 if top > 0.3 and words >= 20 else 1 if top < 0.15 else 0)
    pipes = per(s["n_pipes"], words)
    out.append(-1 if pipes > 0.1 else 1 if pipes < 0.01 else 0)
    return out


def posteriors(votes):
    """EM with the pseudo-counts of the docstring, each document by itself."""
    good = []
    for v in votes:
        cast = sum(map(abs, v))
        good.append((sum(x > 0 for x in v) + 0.5) / (cast + 1) if cast else 0.5)
    soft = ([2.0, 1.0, 1.0], [1.0, 1.0, 2.0])
    for _ in range(100):
        chance = []
        for c in (0, 1):
            rules = []
            for r in range(len(votes[0])):
                counts = list(soft[c])
                for v, g in zip(votes, good):
                    counts[v[r] + 1] += g if c else 1 - g
                rules.append([x / sum(counts) for x in counts])
            chance.append(rules)
        prior = (sum(good) + 1) / (len(good) + 2)
        new = []
        for v in votes:
            odds = math.log(prior / (1 - prior))
            for r, x in enumerate(v):
                w = math.log(chance[1][r][x + 1]) - math.log(chance[0][r][x + 1])
                odds += min(w, 0) if x < 0 else max(w, 0) if x > 0 else w
            new.append(1 / (1 + math.exp(-odds)))
        moved, good = max(abs(a - b) for a, b in zip(new, good)), new
        if moved < 1e-9:
            break
    return good


def test_posteriors_equal_em_a_document_at_a_time(spark):
    rng = random.Random(8)
    texts = []
    for i in range(160):
        words = [rng.choice(FILLER) + (str(rng.randrange(400)) if i % 3 else "") for _ in range(rng.randrange(10, 200))]
        if i % 4 == 0:
            words = [rng.choice(["###", "BUY", "now!!", "|", w]) for w in words]
        texts.append((" " if i % 5 else "\n").join(words))
    rows = quality_rules.quality_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = posteriors([votes_of(r) for r in rows])
    for r, p in zip(rows, want):
        assert r.probability == pytest.approx(p, abs=1e-6)
        assert r.kept == (not r.base_failed and p >= 0.5)


# --- personal data: planted spans -----------------------------------------------------------------


def with_luhn(digits, good=True):
    for last in "0123456789":
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits + last), 1))
        if (total % 10 == 0) == good:
            return digits + last


def iban_of(rng, good=True):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    number = int(body + "131400")  # DE and two zeros
    check = 98 - number % 97
    return f"DE{check if good else check % 97 + 1 if check % 97 + 1 > 9 and check % 97 + 1 != check else 10 + (check == 10):02d}{body}"


def test_added_personal_data_is_what_was_planted():
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randrange(1, 6)):
            text += " ".join(rng.choice(FILLER) for _ in range(20)) + " "  # further than context reaches
            kind, near, good = rng.choice(["iban", "card_like", "phone_like", "ssn", "passport"]), rng.random() < 0.5, rng.random() < 0.7
            if kind == "iban":
                span, said, found = iban_of(rng, good), "bank", good
            elif kind == "card_like":
                d = with_luhn("5" + digits(11), good)
                span, said, found = ".".join((d[:4], d[4:8], d[8:])), "visa", good and near
            elif kind == "phone_like":
                span, said, found = f"0{digits(3)}/{digits(3)}-{digits(4)}", "tel", near
            elif kind == "ssn":
                span, said, found = f"1{digits(2)}-{digits(2)}-{digits(4)}", "social", near
            else:
                span, said, found = f"X{digits(8)}", "passport", near
            text += f"{said if near else 'word'} "
            if found:
                want.append((len(text), len(text) + len(span), kind))
            text += span + " "
        base, more = pii.find_spans(text)
        assert base == [] and sorted(more) == sorted(want), text


# --- secrets: token counts taken straight from the vocabulary -------------------------------------


@pytest.fixture(scope="module")
def count_tokens():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def test_random_spans_follow_the_ratio(count_tokens):
    """Of strings in one part the ratio alone decides, but for known digests and few characters."""
    import public_tokenizers

    find = secrets.finder(public_tokenizers.path(secrets.VOCABULARY))
    rng = random.Random(6)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789", "0123456789abcdefABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ab1"]
    seen = set()
    for _ in range(1500):
        n = rng.randrange(20, 70)
        s = "".join(rng.choice(rng.choice(alphabets)) for _ in range(n)) if rng.random() < 0.3 else "".join(rng.choice(a) for a in [rng.choice(alphabets)] * n)
        if rng.random() < 0.3:
            s = "".join(rng.choice(FILLER).capitalize() for _ in range(6))
        if re.search("AKIA|[0-9a-f]{32}", s):
            continue
        digest = re.fullmatch("(?i)[0-9a-f]+", s) and len(s) in (32, 40, 56, 64, 96, 128)
        wanted = len(s) < secrets.MAX_RATIO * count_tokens(s) and len(set(s)) >= 8 and not digest
        base, more = find(f"it is {s} there")
        assert base == [] and more == ([(6, 6 + len(s), "random")] if wanted else []), s
        seen.add(wanted)
    assert seen == {True, False}
