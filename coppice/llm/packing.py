"""Packing of tokenised documents into sequences: first-fit decreasing in random groups.

A document longer than a sequence is cut into full pieces and a rest; full
pieces are sequences of their own.  The rests are dealt at random into groups
of about GROUP pieces, and each group is packed on its own by first-fit
decreasing, finding the first bin with room in a tournament tree of bin
capacities.  Only (document, start, length) moves between tasks; token ids
never do.

Defined cases: a null text is empty and gives one piece with the closing id
alone; repeated rows are packed each; an empty table gives no sequences; ties
in length go by doc_id and start; a text of any length is tokenised whole and cut
into full pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, cut, mapped, slices, texts_of

VOCABULARY, CLOSING_ID, SEQUENCE = "word_bpe_49k.json", 1, 2048
#: Pieces a group has on average, and distinct strings and words a worker remembers the ids of.
GROUP, MOST_CHUNKS, MOST_WORDS = 8192, 600_000, 250_000


#: Printable ASCII and Latin-1 letters, which lower-case one by one and are in composed form already.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")


class Encoder:
    """Token ids of texts, by the tokenizer at ``path``.

    No token crosses white space, so each distinct string between spaces is
    encoded once and remembered.  Where the tokenizer's own settings are
    composition, single spaces, lower case and one splitting pattern, plain
    strings are split by that pattern here and only new words meet the
    tokenizer's model, many at a time; anything else goes through it whole.
    """

    def __init__(self, path: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids as little-endian 32-bit numbers, so that a text is a join.
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        settings = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (settings["normalizer"] or {}).get("normalizers", [])]
        splits = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = settings["model"].get("end_of_word_suffix")
        self.pattern = None
        if steps == ["NFC", "Replace", "Lowercase"] and suffix and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"]:
            self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = None
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            del vocabulary
        del settings

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of new chunks, by way of the words that plain ones fall into."""
        single: dict[str, str] = {}
        several: dict[str, list[str]] = {}
        other: list[str] = []
        for c in chunks:
            if self.pattern is None or "<|" in c or not PLAIN.fullmatch(c):
                other.append(c)
            elif c.isalpha():
                single[c] = c.lower()
            elif c[-1] in ".," and c[:-1].isalpha():  # what the pattern would give
                several[c] = [c[:-1].lower(), c[-1]]
            else:
                several[c] = self.pattern.findall(c.lower())
        known = self.words
        new = set(single.values())
        new.update(*several.values())
        new = [w for w in new if w not in known]
        if new:
            joined = [" ".join(new[i : i + 1000]) for i in range(0, len(new), 1000)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("a word did not end in one token of the vocabulary")
            flat, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            known.update(zip(new, [flat[a:b] for a, b in zip([0, *ends], ends)]))
        self.chunks.update({c: known[w] for c, w in single.items()})
        self.chunks.update({c: b"".join([known[w] for w in words]) for c, words in several.items()})
        for c, encoded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.chunks[c] = np.array(encoded.ids, "<u4").tobytes()

    def folded(self, text: str) -> str:
        """A text in lower case where that is all the tokenizer's settings would do to its letters, so that fewer strings differ."""
        if self.pattern is None or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the closing one, as little-endian 32-bit numbers."""
        split = [self.folded(t).replace("\n", " ").split(" ") for t in texts]
        # What was met first stays: common words come early.
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks = dict(islice(self.chunks.items(), MOST_CHUNKS // 5))
        if len(self.words) > MOST_WORDS:
            self.words = dict(islice(self.words.items(), MOST_WORDS // 5))
        met: set[str] = set()
        met.update(*split)
        self.learn([c for c in met if c not in self.chunks])
        of = self.chunks.__getitem__
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        return [b"".join(map(of, words)) + closing for words in split]


@cache
def encoder_at(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of ``sequence``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = encoder_at(path or public_tokenizers.path(VOCABULARY))
        for batch in slices(batches, "text", 4 * SLICE_BYTES):
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts_of(batch.column("text")).to_pylist())):
                for at in range(0, len(ids), 4 * sequence):
                    piece = ids[at : at + 4 * sequence]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return mapped(columns, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, given in decreasing order.

    ``tree[1]`` is the largest room among all bins, ``tree[i]`` that below node
    i; going left whenever the left has room finds the first bin that fits.
    """
    size = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < size:
            node *= 2
            if tree[node] < n:
                node += 1
        bins.append(node - size)
        offsets.append(capacity - tree[node])
        tree[node] -= n
        while node > 1:
            node //= 2
            new = tree[2 * node] if tree[2 * node] > tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == new:
                break
            tree[node] = new
    return bins, offsets


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences hold at most ``sequence`` tokens, gapless from 0."""
    cut_up = cut(pieces(docs, path, sequence).withColumn("row", F.monotonically_increasing_id()))
    n_groups = max(1, -(-cut_up.where(F.col("length") < sequence).count() // group))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), sequence)
        out = pdf[columns].copy()
        out["sequence_id"] = pdf["group"].to_numpy() * np.int64(2 * group * 1024) + np.array(bins, np.int64)
        out["offset"] = np.array(offsets, np.int64)
        return out

    # Rows are dealt by their place in the written table, so that repeated documents spread like others.
    rests = cut_up.where(F.col("length") < sequence).withColumn("group", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_groups)))
    schema = ", ".join(f"{c} long" for c in (*columns, "sequence_id", "offset"))
    done = rests.groupBy("group").applyInPandas(pack, schema)
    # Full pieces are sequences by themselves, numbered below zero apart from the groups' ids.
    full = cut_up.where(F.col("length") == sequence).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return done.union(full)
