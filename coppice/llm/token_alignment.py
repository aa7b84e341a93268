"""Which tokens of two tokenizers cover the same bytes, text by text and over a corpus.

Tokenizer A is a byte-level BPE file, given a space and the text; B a sentence
piece BPE model, given the text, to which it adds the space itself.  Where the
bytes of either's tokens don't spell the space and the text, the text has no
tokens.  Byte offsets at which tokens of both end cut a text into groups; within
a group each token of A is linked with each of B whose bytes overlap its own.

The alignment is NumPy over many texts at once: running sums of token lengths
are the ends, ``intersect1d`` finds the common cuts, ``searchsorted`` labels the
groups and tells the tokens of B that a token of A meets, and links are made by
``repeat``.  Neither tokenizer has a token across a border between a character
that is no white space and a space or newline, or behind a single newline (checked
for the vocabulary of B when it is opened; it follows from A's splitting pattern),
so both tokenize the stretches between such borders by themselves, and a worker
aligns each distinct stretch once while it remembers it.

Counts of linked pairs over the corpus are sums of tasks' sums by (pair, salt)
and then by pair.  They are written as sorted mapped arrays (mapped_arrays), and
each text's links, kept compressed beside the first pass, look their counts up
there: links never meet in a join, however common a pair is.

Defined cases: null and empty texts, and those not spelled by their tokens, have
zeros and an empty groups_sha256; rows that repeat count each, also in the
corpus; strings of special tokens are plain text; a text of any length is
tokenized whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapped_arrays import Table, bits_for, packed, reduced, shard_of, summed, unpacked
from .shared import mapped, shared_dir, slices, texts_of
from .words import mix

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches a worker remembers, pairs a task adds up at once, and salts a pair is dealt over.
MOST_STRETCHES, MOST_PAIRS, SALTS = 200_000, 1 << 20, 16
#: White space of both tokenizers, what Python takes for it but for four control characters; other characters; and white
#: space that may be within a token of B.
_SPACE, _OTHER, _INNER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", r"[^\S \n\x1c-\x1f]"
_MORE = f"(?:{_INNER}{_SPACE}*{_OTHER}*)*"
#: A newline between two other characters, a word with at most one space before it, or more white space with what follows.
STRETCH = re.compile(rf"\n(?={_OTHER})| ?{_OTHER}+{_MORE}|[ \n]{_SPACE}*{_OTHER}*{_MORE}")
#: A's entries are written with these for the bytes that are not printable, in order from 256.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def overlapping(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in A, index in B) of every two tokens whose bytes overlap; both cover the same bytes."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts_a, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common cuts, and the group each token of A and of B is in."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        other = (b for b in range(256) if b not in set(PRINTABLE))
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + n): b for n, b in enumerate(other)}
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for entry, n in self.a.get_vocab().items():
            self.bytes_a[n] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("pieces go beyond a word, so texts can't be tokenized a stretch at a time")
        self.line_start, self.space = len(self.b.encode("\n")), self.b.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of stretches as they stand in a text that begins with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        # B adds a space: where a stretch has one it is left out, else a newline takes it and both are dropped.
        spaced = [s.startswith(" ") for s in stretches]
        b = self.b.encode([s[1:] if own else "\n" + s for s, own in zip(stretches, spaced, strict=True)], num_threads=1)
        # A lone space is nothing behind the added one.
        b = [((ids or [self.space]) if own else ids[self.line_start :]) for ids, own in zip(b, spaced, strict=True)]
        return a, b


class Aligner:
    """Aligned stretches a worker remembers: counts, the written groups, and the linked pairs of each."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.known = tokenizers, {}
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in x], np.int64) for x in (tokenizers.bytes_a, tokenizers.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links; and whether the bytes are right
        self.written: list[str] = []
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, stretches: list[str]) -> None:
        """Align stretches that are not known, all at once."""
        ids_a, ids_b = self.tokenizers.encode(stretches)
        spell = lambda ids, table: b"".join([table[i] for i in ids])
        right = [spell(a, self.tokenizers.bytes_a) == (s := t.encode()) and spell(b, self.tokenizers.bytes_b) == s for t, a, b in zip(stretches, ids_a, ids_b, strict=True)]
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, right, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        if len(a):
            cuts, group_a, group_b = groups(ends_a, ends_b)
            from_a, from_b = overlapping(ends_a, ends_b)
        else:
            cuts = group_a = group_b = from_a = from_b = np.zeros(0, np.int64)
        of_a = np.repeat(np.arange(len(stretches)), n_a)  # the stretch of each token of A
        count = lambda x: np.bincount(x, minlength=len(stretches))
        n_groups, n_links = count(of_a[np.searchsorted(group_a, np.arange(len(cuts)))]) if len(a) else count(of_a), count(of_a[from_a])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, np.array(right, np.int64)], axis=1)])
        self.pairs = np.concatenate([self.pairs, a[from_a] * len(self.sizes_b) + b[from_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.written += self._written(a, b, group_a, group_b, n_groups)
        for s in stretches:
            self.known[s] = len(self.known)

    @staticmethod
    def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each stretch as text: ids of A, a bar, ids of B."""
        bounds_a, bounds_b = (np.searchsorted(g, np.arange(n_groups.sum() + 1)).tolist() for g in (group_a, group_b))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        each = [f"{','.join(text_a[bounds_a[g] : bounds_a[g + 1]])}|{','.join(text_b[bounds_b[g] : bounds_b[g + 1]])}" for g in range(len(bounds_a) - 1)]
        last = np.cumsum(n_groups).tolist()
        return [";".join(each[z - n : z]) for z, n in zip(last, n_groups.tolist(), strict=True)]

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: counts (tokens of A, of B, groups, links), its groups as text, and its pairs with how often each is linked."""
        split = [STRETCH.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > MOST_STRETCHES:
            self.forget()
        if new := list({s: None for own in split for s in own if s not in self.known}):
            self.learn(new)
        known = self.known
        for own in split:
            at = np.array([known[s] for s in own], np.int64)
            counts = self.counts[at]
            if not len(at) or not counts[:, 4].all():
                yield np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            distinct, times = np.unique(at, return_counts=True)
            n = self.counts[distinct, 3]
            pairs = self.pairs[np.repeat(self.first[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield counts[:, :4].sum(axis=0), ";".join([self.written[i] for i in at.tolist()]), pairs, np.repeat(times, n)


_FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary, pairs array<long>, counts array<long>, salt int"
_NAMES = [x.split()[0] for x in _FIRST.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]


def first_pass(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a text with its counts and links, and rows of a task's summed pairs (whose groups_sha256 is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(path_a, path_b))
        held_pairs, held_times = [], []
        # Another salt for each task, so that the tasks' sums of a common pair meet in several places first.
        salt = TaskContext.get().partitionId() % SALTS

        def sums() -> pa.RecordBatch:
            places, n = summed((whole := np.concatenate(held_pairs)).astype(np.uint64), np.concatenate(held_times))
            found = whole[places]
            held_pairs[:], held_times[:] = [found], [n]
            columns = [pa.nulls(1, t) for t in _TYPES]
            columns[8], columns[9], columns[10] = pa.array([found], _TYPES[8]), pa.array([n], _TYPES[9]), pa.array([salt], pa.int32())
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in slices(batches, "text"):
            rows = list(aligner.align(texts_of(batch.column("text")).to_pylist()))
            counts = np.array([r[0] for r in rows], np.int64)
            links, times = [], []
            for _, _, pairs, n in rows:
                order = np.argsort(pairs)
                links.append(packed(np.diff(pairs[order], prepend=0)))
                times.append(packed(n[order].astype(np.int64)))
            held_pairs += [r[2] for r in rows]
            held_times += [r[3] for r in rows]
            columns = [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array([hashlib.sha256(r[1].encode()).hexdigest() if r[1] else "" for r in rows]), pa.array(links, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rows), t) for t in _TYPES[8:])], _NAMES)
            if sum(map(len, held_pairs)) > MOST_PAIRS:
                made = sums()
                if len(held_pairs[0]) > MOST_PAIRS // 2:
                    yield made
                    held_pairs, held_times = [], []
        if held_pairs:
            yield sums()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _FIRST)


def pair_counts(sums: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair is linked, and whether no other pair of its B id is linked more."""
    each = sums.select("salt", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("salt", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    salted = each.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def written_pairs(pairs: DataFrame, n_b: int, folder: str, n_pairs: int) -> Table:
    """The pair counts as a mapped table; ``pairs`` has pair, n."""
    table = Table(folder, "pairs", bits_for(n_pairs), [("n", "<i8"), ("best", "u1")])
    bits = table.bits
    most = pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
    marked = pairs.withColumn("b", F.col("pair") % n_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
            keys = mix(pair.astype(np.uint64))
            shard = shard_of(keys, bits)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
            rows = [{"shard": int(s), "data": [packed(keys[own]), packed(n[own].astype(np.int64)), packed(best[own].astype(np.uint8))]} for s in np.flatnonzero(np.diff(bounds)) if len(own := order[bounds[s] : bounds[s + 1]])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("data", pa.list_(pa.binary()))]))

    def write(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, n, best = (np.concatenate([unpacked(r["data"][k], t) for r in rows]) for k, t in enumerate((np.uint64, np.int64, np.uint8)))
        order = np.argsort(keys)
        table.write(shard, keys[order], n[order], best[order])
        yield pa.RecordBatch.from_pylist([{"shard": shard, "entries": len(keys)}], pa.schema([("shard", pa.int32()), ("entries", pa.int64())]))

    sizes = reduced(mapped(marked, deal, "shard int, data array<binary>"), table.shards, write, "shard int, entries long").collect()  # one row a shard
    return table.of([(r.shard, r.entries) for r in sizes])


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    # Links are as many as the tokens, so they are written once, compressed, rather than made again.
    first_pass(docs, path_a, path_b).write.option("compression", "zstd").parquet(f"{folder}/texts")
    done = spark.read.schema(_FIRST).parquet(f"{folder}/texts")
    pair_counts(done.where("groups_sha256 is null").select("salt", "pairs", "counts")).write.option("compression", "zstd").parquet(f"{folder}/counts")
    pairs = spark.read.schema("pair long, n long").parquet(f"{folder}/counts")
    table = written_pairs(pairs, n_b, folder, pairs.count())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = table.reader()
        for batch in slices(batches, "links"):
            links = [np.cumsum(unpacked(x, np.int64)) for x in batch.column("links").to_pylist()]
            times = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, np.int64) for x in batch.column("times").to_pylist())])
            distinct, back = np.unique(np.concatenate([np.zeros(0, np.int64), *links]).astype(np.uint64), return_inverse=True)
            place, n, best = reader.find(mix(distinct))
            if (place < 0).any():
                raise ValueError("a linked pair has no count")
            upto = np.concatenate([[0], np.cumsum([len(x) for x in links])])
            each = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])  # noqa: B023, E731
            made = [pa.array(each(times * best[back])), pa.array(each(times * n[back]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), *made, batch.column("groups_sha256")], names)

    rows = done.where("groups_sha256 is not null").select(*names[:5], "groups_sha256", "links", "times")
    return mapped(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
