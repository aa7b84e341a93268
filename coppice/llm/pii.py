"""Personal data in whole texts: patterns propose, checksums confirm, context decides.

Base spans (email, ip, card, phone) follow fixed patterns.  The method adds
spans that the patterns alone can't be trusted with: international bank account
numbers confirmed by mod-97, cards written with other separators or of 13
digits confirmed by Luhn, and phone, social-security and passport numbers in
national forms.  Every proposal starts from its kind's score, a checksum that holds raises
it, and each word of its kind's context list nearby raises it further; it is
added at THRESHOLD or more, and only where no stronger span overlaps it.

Defined cases: a null text is empty and has no spans; repeated rows give the
same spans each; a text of any length is searched whole, in time linear in it;
of proposals with equal scores the earlier goes first; an empty table gives an
empty result; other columns are ignored (span table) or kept (masking).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, slices, texts_of
from .spans import Occupied, Span, masked, span_table

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "card_like", "phone_like", "ssn", "passport")
THRESHOLD, CHECKED, NEARBY, REACH = 0.7, 0.5, 0.3, 48

#: The two sides of an email: one is sought from each @, so that time stays linear in the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does: what fails there fails further on in the run.
NUMBERS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Pattern, starting score, and context words of each added kind.
PROPOSALS = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.3, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "card_like": (re.compile(r"(?<![0-9.])[0-9](?:[./\x20-]?[0-9]){12,18}(?![0-9.])"), 0.1, ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta")),
    "phone_like": (re.compile(r"(?<![0-9+.])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"), 0.4, ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone")),
    "ssn": (re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), 0.4, ("ssn", "social", "security")),
    "passport": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{7,8}(?![A-Za-z0-9])"), 0.4, ("passport", "reisepass", "passeport", "pasaporte")),
}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def digits_of(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return (sum(digits[-1::-2]) + sum(_DOUBLED[d] for d in digits[-2::-2])) % 10 == 0


def mod97(s: str) -> bool:
    """The check of international bank account numbers: letters count 10 to 35, the remainder is 1."""
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping emails: the run of local characters before an @, back to the last match or @ at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - len(before) + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = list(emails(text))
    for m in NUMBERS.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


def confirmed(kind: str, s: str) -> bool:
    return mod97(s) if kind == "iban" else kind == "card_like" and 13 <= len(d := digits_of(s)) <= 19 and luhn(d)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Proposals whose score reaches THRESHOLD, best first where they overlap."""
    scored = []
    for kind, (pattern, score, context) in PROPOSALS.items():
        for m in pattern.finditer(text):
            if kind in ("iban", "card_like") and not confirmed(kind, m[0]):
                continue
            score_here = score + CHECKED * confirmed(kind, m[0])
            near = set(re.findall(r"\w+", text[max(0, m.start() - REACH) : m.start()].lower()) + re.findall(r"\w+", text[m.end() : m.end() + REACH].lower()))
            score_here += NEARBY * sum(w in near for w in context)
            if score_here >= THRESHOLD:
                scored.append((-score_here, m.start(), m.end(), kind))
    taken = Occupied(base)
    out: list[Span] = []
    for _, a, b, kind in sorted(scored):
        if taken.free(a, b):
            taken.add(a, b)
            out.append((a, b, kind))
    return out


_DIGITS = re.compile(r"[0-9]{2}")


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, added_spans(text, base) if _DIGITS.search(text) else []


def pii_table(docs: DataFrame) -> DataFrame:
    """Per document its counts of base kinds, the digest of base spans, and all spans."""
    return span_table(docs, lambda: find_spans, BASE_KINDS, MORE_KINDS)


def mapped_text(docs: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """``docs`` with ``text`` changed; n_chars, where there is one, follows.  Null texts stay null."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [None if t is None else change(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    done = mapped(packed, run, packed.schema)
    back = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("text").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[back[c].alias(c) for c in docs.columns])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind."""

    def change(text: str) -> str:
        base, more = find_spans(text)
        return masked(text, base + more) if base or more else text

    return mapped_text(docs, change)
