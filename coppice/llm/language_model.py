"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and read from mapped arrays.

Tokens are the words of a text, A-Z lower-cased, and one end; a text is preceded
by ``order - 1`` beginnings, so each token has a whole n-gram.  The highest order
counts occurrences, each lower one the distinct words before its n-gram; the
unigrams are interpolated with a uniform share for each training word and one
unknown word:

    p(w | h) = (a - D(a)) / total(h) + (D1 n1 + D2 n2 + D3 n3) / total(h) * p(w | h')

with a the count of hw, total and n1, n2, n3 the sum of the counts behind h and
how many are 1, 2, or more, and h' the context without its first word; a context
that was not seen leaves p(w | h').  Discounts follow from each order's counts
of counts; one that these can't give (0 < D < k fails) is FALLBACK's.

Words are numbered by their place in the sorted array of word hashes.  A task
adds up the n-grams of a million tokens at a time and sends them to shards by
hash; a shard's task writes its sorted array, and sends on the distinct n-grams
without their first word (the counts of the order below) and what stands behind
each context.  So every order is counted from the one above, no shard holds more
than its share, however frequent a word, and the driver sees a few sums a shard.
Scoring looks n-grams and contexts up in the mapped arrays.

Defined cases: a null text is empty and has the end alone; a null doc_id is not
held out; repeated rows are learned and scored each; a word or text of any length
counts whole; with nothing to learn from every token has probability 1; an empty
table gives no rows; other columns are ignored.  Words and n-grams of three and
more are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapped_arrays import Table, bits_for, packed, reduced, shard_of, summed, unpacked
from .shared import cut, mapped, shared_dir, slices, texts_of
from .words import Words, mix

ORDER = 2
#: Discounts of counts 1, 2, and 3 or more where counts of counts can't tell them.
FALLBACK = (0.5, 1.0, 1.5)
#: The hash of the end of a text, which no word has but by chance.
END = np.uint64(0x5DEECE66D1CE4E5B)
TASK_TOKENS, TEXT_BYTES = 1 << 20, 2 << 20
_PACKED = "role string, shard int, entries long, ids array<binary>, counts array<binary>"


def held_out(doc_id: Column) -> Column:
    """Documents the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, an end behind each, and where each text's begin."""
    words = Words(texts_of(texts), lower=True)
    firsts = words.first + np.arange(len(words.first))
    tokens = np.full(firsts[-1], END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[firsts[1:] - 1] = False
    tokens[inside] = words.hashes()
    return tokens, firsts


def ngram_keys(ids: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each n-gram; of one or two 32-bit words it is one to one."""
    if len(ids) == 2 and ids[0].dtype == np.uint32:
        return mix((ids[0].astype(np.uint64) << np.uint64(32)) | ids[1])
    key = mix(ids[0].astype(np.uint64))
    with np.errstate(over="ignore"):
        for more in ids[1:]:
            key = mix(key + mix(more.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)))
    return key


def _packed_rows(role: str, bits: int, ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct n-grams and their counts, a row a shard; in a shard they stand by their words, the first as differences."""
    shard = shard_of(ngram_keys(ids), bits)
    order = np.lexsort((*ids[::-1], shard))
    bounds = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    rows: list[dict] = []
    for n in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[n] : bounds[n + 1]]
        first = np.diff(ids[0][own], prepend=np.zeros(1, ids[0].dtype))
        rows.append({"role": role, "shard": int(n), "entries": len(own), "ids": [packed(first), *(packed(i[own]) for i in ids[1:])], "counts": [packed(c[own]) for c in counts]})
    return pa.RecordBatch.from_pylist(rows, _ARROW_PACKED)


_ARROW_PACKED = pa.schema([("role", pa.string()), ("shard", pa.int32()), ("entries", pa.int64()), ("ids", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])


def _merged(rows: list[dict], kind, count_kinds: list) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys in order, words and sums of counts of a shard's distinct n-grams."""
    width = len(rows[0]["ids"])
    columns = []
    for k in range(width):
        parts = [unpacked(r["ids"][k], kind) for r in rows]
        columns.append(np.concatenate([np.cumsum(p, dtype=kind) if k == 0 else p for p in parts]))
    counts = [np.concatenate([unpacked(r["counts"][k], c) for r in rows]) for k, c in enumerate(count_kinds)]
    keys = ngram_keys(columns)
    places, *sums = summed(keys, *counts)
    return keys[places], [c[places] for c in columns], sums


def learned_words(texts: DataFrame, folder: str, bits: int) -> tuple[Table, int]:
    """The table of training words (their counts), and how many tokens there are."""
    table = Table(folder, "words", bits, [("count", "<i8")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def rows() -> pa.RecordBatch:
            places, sums = summed(whole := np.concatenate(keys), np.concatenate(counts))
            found = whole[places]
            bounds = np.searchsorted(shard_of(found, bits), np.arange((1 << bits) + 1))
            out = [{"role": "words", "shard": int(n), "entries": int(bounds[n + 1] - bounds[n]), "ids": [packed(found[bounds[n] : bounds[n + 1]])], "counts": [packed(sums[bounds[n] : bounds[n + 1]])]} for n in np.flatnonzero(np.diff(bounds))]
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_pylist(out, _ARROW_PACKED)

        for batch in slices(batches, "text", TEXT_BYTES):
            tokens, _ = token_hashes(batch.column("text"))
            places, n = summed(tokens, np.ones(len(tokens), np.int64))
            keys.append(tokens[places])
            counts.append(n)
            if sum(map(len, keys)) >= TASK_TOKENS:
                yield rows()
        if keys:
            yield rows()

    def write(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([unpacked(r["ids"][0], np.uint64) for r in rows])
        places, sums = summed(keys, np.concatenate([unpacked(r["counts"][0], np.int64) for r in rows]))
        table.write(shard, keys[places], sums)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "entries": len(places), "tokens": int(sums.sum())}], pa.schema([("shard", pa.int32()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    sizes = reduced(mapped(texts, count, _PACKED), table.shards, write, "shard int, entries long, tokens long").collect()
    return table.of([(r.shard, r.entries) for r in sizes]), sum(r.tokens for r in sizes)


@dataclass
class Level:
    """The n-grams of one length, what stands behind their contexts (none for single words), and sums over the whole level."""

    grams: Table
    contexts: Table | None
    total: int
    seen: tuple[int, ...]  # how many n-grams have count 1, 2, 3, 4, and 3 or more

    def discounts(self) -> np.ndarray:
        """What to take from counts 0, 1, 2, and 3 or more."""
        n = self.seen
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
        return np.array([0.0, *(d if 0 < d < k else other for k, (d, other) in enumerate(zip(found, FALLBACK, strict=True), 1))])


class LanguageModel:
    """Words and levels, from single words up."""

    def __init__(self, words: Table, tokens: int, levels: list[Level]):
        self.words, self.tokens, self.levels = words, tokens, levels

    @property
    def vocabulary(self) -> int:
        return int(self.words.sizes.sum())

    @classmethod
    def fit(cls, texts: DataFrame, order: int = ORDER, folder: str | None = None) -> LanguageModel:
        """From a frame with a column text."""
        if order < 2:
            raise ValueError("a model has at least two words in an n-gram")
        folder = folder or f"{shared_dir(texts.sparkSession)}/lm-{uuid.uuid4().hex}"
        texts = texts.select("text")
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
        bits = bits_for(size["bytes"] / 6 + size["rows"])
        words, tokens = learned_words(texts, folder, bits)
        numbers = _Numbers(words)
        rows = mapped(texts, lambda batches: _occurring(batches, numbers, order, bits), _PACKED)
        levels: list[Level] = []
        for length in range(order, 0, -1):
            level, below = _level(rows, folder, length, bits, numbers.kind, "<u4" if tokens < 1 << 32 else "<i8")
            levels.insert(0, level)
            rows = below
        return cls(words, tokens, levels)


class _Numbers:
    """Word numbers: places in the table of words; the beginning and unknown words come behind."""

    def __init__(self, words: Table):
        self.table, self.vocabulary = words, int(words.sizes.sum())
        self.kind = np.uint32 if self.vocabulary + 2 < 1 << 32 else np.uint64

    def open(self) -> _Numbers:
        self.reader = self.table.reader()
        return self

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each token."""
        distinct, back = np.unique(hashes, return_inverse=True)
        place, count = self.reader.find(distinct)
        number = np.where(place < 0, self.vocabulary + 1, place).astype(self.kind)
        return number[back], count[back]

    def ngrams(self, numbers: np.ndarray, firsts: np.ndarray, order: int) -> list[np.ndarray]:
        """The columns of each token's n-gram, beginnings before each text."""
        pads = order - 1
        row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        at = np.arange(len(numbers)) + (row + 1) * pads
        line = np.full(len(numbers) + (len(firsts) - 1) * pads, self.vocabulary, self.kind)
        line[at] = numbers
        return [line[at - pads + k] for k in range(order)]


def _occurring(batches: Iterator[pa.RecordBatch], numbers: _Numbers, order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed n-grams of training texts, added up a million tokens at a time."""
    numbers.open()
    held: list[list[np.ndarray]] = []
    n = 0

    def rows() -> pa.RecordBatch:
        columns = [np.concatenate([h[k] for h in held]) for k in range(order)]
        held.clear()
        places, counts = summed(ngram_keys(columns), np.ones(len(columns[0]), np.int64))
        return _packed_rows("grams", bits, [c[places] for c in columns], [counts])

    for batch in slices(batches, "text", TEXT_BYTES):
        tokens, firsts = token_hashes(batch.column("text"))
        held.append(numbers.ngrams(numbers.of(tokens)[0], firsts, order))
        n += len(tokens)
        if n >= TASK_TOKENS:
            yield rows()
            n = 0
    if held:
        yield rows()


def _level(rows: DataFrame, folder: str, length: int, bits: int, kind, count_kind: str) -> tuple[Level, DataFrame | None]:
    """Write the tables of one length from its packed n-grams; also the packed n-grams one shorter."""
    grams = Table(folder, f"grams{length}", bits, [("count", count_kind)])
    contexts = Table(folder, f"contexts{length}", bits, [("total", "<i8"), *((f"n{k}", count_kind) for k in (1, 2, 3))])

    def write(shard: int, own: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, ids, (counts,) = _merged(own, kind, [np.int64])
        grams.write(shard, keys, counts)
        seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]
        yield pa.RecordBatch.from_pylist([{"role": "level", "shard": shard, "entries": len(keys), "counts": [np.array([counts.sum(), *seen], np.int64).tobytes()]}], _ARROW_PACKED)
        if length == 1:
            return
        shorter = ids[1:]
        places, before = summed(ngram_keys(shorter), np.ones(len(keys), np.int64))
        yield _packed_rows("grams", bits, [c[places] for c in shorter], [before])
        behind = ids[:-1]
        places, *sums = summed(ngram_keys(behind), counts, counts == 1, counts == 2, counts >= 3)
        yield _packed_rows("contexts", bits, [c[places] for c in behind], list(sums))

    done = cut(reduced(rows, grams.shards, write, _PACKED))
    found = done.where("role = 'level'").select("shard", "entries", F.col("counts")[0].alias("sums")).collect()  # one row a shard
    sums = np.sum([np.frombuffer(r.sums, np.int64) for r in found], axis=0) if found else np.zeros(6, np.int64)
    level = Level(grams.of([(r.shard, r.entries) for r in found]), None, int(sums[0]), tuple(int(x) for x in sums[1:]))
    if length == 1:
        return level, None

    def write_contexts(shard: int, own: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, _, values = _merged(own, kind, [np.int64] * 4)
        contexts.write(shard, keys, *values)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "entries": len(keys)}], pa.schema([("shard", pa.int32()), ("entries", pa.int64())]))

    sizes = reduced(done.where("role = 'contexts'").select("shard", "ids", "counts"), contexts.shards, write_contexts, "shard int, entries long").collect()
    level.contexts = contexts.of([(r.shard, r.entries) for r in sizes])
    return level, done.where("role = 'grams'").select("shard", "ids", "counts")


class Scorer:
    """A worker's view of a model: its tables, mapped as texts need them."""

    def __init__(self, model: LanguageModel):
        self.model, self.numbers = model, _Numbers(model.words).open()
        self.levels = [(x, x.grams.reader(), x.contexts.reader() if x.contexts else None, x.discounts()) for x in model.levels]

    def probabilities(self, tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability and the training count of each token."""
        numbers, counts = self.numbers.of(tokens)
        columns = self.numbers.ngrams(numbers, firsts, len(self.levels))
        p = np.full(len(tokens), 1.0 / (self.model.vocabulary + 1))
        for length, (level, grams, contexts, discounts) in enumerate(self.levels, 1):
            own = columns[len(columns) - length :]
            keys, back = np.unique(ngram_keys(own), return_inverse=True)
            a = grams.find(keys)[1].astype(np.int64)[back]
            if contexts is None:
                total, n = np.full(len(p), level.total), [level.seen[0], level.seen[1], level.seen[4]]
            else:
                keys, back = np.unique(ngram_keys(own[:-1]), return_inverse=True)
                total, *n = (x.astype(np.int64)[back] for x in contexts.find(keys)[1:])
            left = sum(d * x for d, x in zip(discounts[1:], n, strict=True))
            safe = np.maximum(total, 1)
            p = np.where(total > 0, (a - discounts[np.minimum(a, 3)]) / safe + left / safe * p, p)
        return p, counts


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    model = LanguageModel.fit(given.where(~F.col("held_out")), order)
    known = float(model.tokens + model.vocabulary + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", TEXT_BYTES):
            tokens, firsts = token_hashes(batch.column("text"))
            p, counts = scorer.probabilities(tokens, firsts)
            each = lambda x: np.add.reduceat(x, firsts[:-1])  # noqa: B023, E731
            columns = [np.diff(firsts), each((counts > 0).astype(np.int64)), np.full(batch.num_rows, model.tokens), each(np.log10((counts + 1) / known)), each(np.log10(p))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)], names)

    return mapped(given, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
