"""Secrets in whole texts: fixed patterns, and strings that a tokenizer finds hard to compress.

Base spans (assign, access, hex) follow fixed patterns.  The method adds spans
of kind "random": long unbroken strings whose characters per token, under a
byte-level vocabulary, are so few that they can't be words.  Known digests
(hex of a digest's length), UUIDs and identifiers are excluded first.  An
identifier is a string in which most letters and digits stand in parts
(between underscores, dashes, slashes and the like) that the vocabulary spells
in few tokens.  What isn't random as a whole is searched for random stretches
of its parts, so a key joined to words by such a sign is found; a key glued to
words without a sign is measured with them.

Defined cases: a null text is empty and has no spans; repeated rows give the
same spans each; a text of any length is searched whole, in time linear in it;
of stretches with equal sums the shorter is taken; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .spans import Occupied, Span, span_table

BASE_KINDS, MORE_KINDS = ("assign", "access", "hex"), ("random",)
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate has at least this many characters, and is random below this many characters a token.
MIN_CHARS, MAX_RATIO = 20, 2.1

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
PART = re.compile(r"[A-Za-z0-9]+")
#: Numbers of up to this many digits (years, dates, versions) count as spelled.
NUMBER_DIGITS = 4


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):  # every match holds one of them, whatever its case
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of 32 or more matches from its own start, so the minimum can stand in the pattern.
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_known(s: str) -> bool:
    """Digests, UUIDs and rules of few characters: long, hard to compress perhaps, but not secrets."""
    return len(set(s)) < 8 or bool(DIGEST.fullmatch(s) or UUID.fullmatch(s))


def surplus(part: str, tokens: Callable[[str], int]) -> float:
    """Characters by which a part falls short of MAX_RATIO a token; -1 or less for a part that the vocabulary spells."""
    n = tokens(part)
    short = MAX_RATIO * n - len(part)
    spelled = short <= 0 or (n == 1 and len(part) > 1) or (len(part) <= NUMBER_DIGITS and part.isdigit())
    return min(short, -1.0) if spelled else short


def stretches(parts: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(start, end) of the stretches of (start, end, surplus) with the largest sums, left to right.

    A stretch ends where its sum is used up or MIN_CHARS below its peak; parts
    after the peak are looked at again, at most MIN_CHARS + 1 of them.
    """
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(parts):
        if parts[i][2] <= 0:
            i += 1
            continue
        total = peak = 0.0
        j = last = i
        while j < len(parts):
            total += parts[j][2]
            if total > peak:
                peak, last = total, j
            elif total <= 0 or peak - total > MIN_CHARS:
                break
            j += 1
        out.append((parts[i][0], parts[last][1]))
        i = last + 1
    return out


def random_spans(text: str, start: int, end: int, taken: Occupied, tokens: Callable[[str], int]) -> list[Span]:
    """The random spans of one candidate: all of it, or else stretches of its parts outside the base spans."""
    s = text[start:end]
    if is_known(s):
        return []
    parts = [(m.start(), m.end(), surplus(m[0], tokens)) for m in PART.finditer(text, start, end)]
    odd = sum(b - a for a, b, short in parts if short > 0)
    if 2 * odd >= sum(b - a for a, b, _ in parts) and taken.free(start, end) and len(s) < MAX_RATIO * tokens(s):
        return [(start, end, "random")]
    # A part that a base span touches ends a stretch.
    parts = [(a, b, short if taken.free(a, b) else float("-inf")) for a, b, short in parts]
    return [(a, b, "random") for a, b in stretches(parts) if b - a >= MIN_CHARS and not is_known(text[a:b])]


def added_spans(text: str, base: list[Span], tokens: Callable[[str], int]) -> list[Span]:
    out: list[Span] = []
    taken = Occupied(base)
    for m in CANDIDATE.finditer(text):
        out += random_spans(text, m.start(), m.end(), taken, tokens)
    return out


def load_counter(path: str) -> Callable[[str], int]:
    """Tokens of a string under a tiktoken vocabulary file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def finder(path: str) -> Callable[[str], tuple[list[Span], list[Span]]]:
    """A span finder that loads its vocabulary when the first candidate appears."""
    loaded: list[Callable[[str], int]] = []

    def tokens(s: str) -> int:
        if not loaded:
            loaded.append(load_counter(path))
        return loaded[0](s)

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, added_spans(text, base, tokens)

    return find


def secret_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document its counts of base kinds, the digest of base spans, and all spans."""

    def find():
        import public_tokenizers

        return finder(vocabulary or public_tokenizers.path(VOCABULARY))

    return span_table(docs, find, BASE_KINDS, MORE_KINDS)
