"""Quality rules: weak supervision in place of all-must-pass filtering.

Rules look at statistics of a whole text and vote good (1), bad (-1) or abstain
(0).  Expectation-maximisation over the counts of vote patterns estimates how
often each rule votes each way for good and for bad documents; the posterior
probability of good quality then decides.  Only pattern counts (at most
3 ** number of rules, whatever the corpus size) reach the driver.

Defined cases: a null text counts as empty (no words, so it fails the base
rules); repeated rows are judged alike; an empty table gives an empty result; a
text of any length is looked at whole, in pieces; a posterior equal to the
threshold keeps; all columns of the input are kept and none of their names matters, since the
statistics travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, mapped, slices, texts_of
from .words import PIECE, Words

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_exclaim", "n_pipes", "n_marks", "n_distinct", "n_top_word",
)
STATS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 3


def _class(test) -> np.ndarray:
    return np.array([test(chr(b)) for b in range(256)], np.int64)


#: Bytes that a statistic counts.
CLASSES = {
    "n_marks": _class(lambda c: "!" <= c <= "~" and not c.isalnum()), "n_upper": _class(lambda c: "A" <= c <= "Z"),
    "n_letters": _class(lambda c: "A" <= c <= "Z" or "a" <= c <= "z"), "n_exclaim": _class(lambda c: c == "!"), "n_pipes": _class(lambda c: c == "|"),
}


def byte_counts(words: Words) -> np.ndarray:
    """How often each byte occurs in each row, in pieces, as counting widens its input."""
    out = np.zeros((len(words.offsets) - 1, 256), np.int64)
    for row, (start, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())):
        for at in range(start, end, PIECE):
            out[row] += np.bincount(words.data[at : min(at + PIECE, end)], minlength=256)
    return out


def line_counts(text: str) -> tuple[int, int]:
    """Lines holding a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics named in STATS, one array each."""
    words = Words(texts)
    hashes = words.hashes()
    windows, bounds = words.shingles(WINDOW, hashes)
    n_words = words.counts()
    out = {s: np.zeros(len(texts), np.int64) for s in STATS}
    out["n_words"] = n_words
    seen = byte_counts(words)
    for name, wanted in CLASSES.items():
        out[name] = seen @ wanted
    for row, text in enumerate(texts.to_pylist()):
        out["word_chars"][row] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][row] = sum(map(text.count, SYMBOLS))
        out["n_lines"][row], out["n_dup_lines"][row] = line_counts(text)
        own = windows[bounds[row] : bounds[row + 1]]
        ordered = np.sort(own)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            twice = np.isin(own, again)
            marked = np.zeros(len(own) + WINDOW - 1, bool)
            for k in range(WINDOW):
                marked[k : k + len(own)] |= twice
            out["n_repeat_words"][row] = marked.sum()
        if n_words[row]:
            ordered = np.sort(hashes[words.first[row] : words.first[row + 1]])
            runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            out["n_distinct"][row] = len(runs) - 1
            out["n_top_word"][row] = np.diff(runs).max()
    return out


def with_stats(docs: DataFrame, keep: list[str], text: str = "text", name: str = "stats") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``name`` of text statistics."""
    others = [c for c in keep if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.lit(0).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    row_type = packed.schema["row"].dataType
    carried = text in keep
    fields = [T.StructField("row", row_type), T.StructField("stats", STATS_TYPE)] + [T.StructField("text", T.StringType())] * carried

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stats = text_stats(texts_of(batch.column("text")))
            struct = pa.StructArray.from_arrays([pa.array(stats[s]) for s in STATS], list(STATS))
            columns = [batch.column("row"), struct] + [batch.column("text")] * carried
            yield pa.RecordBatch.from_arrays(columns, ["row", "stats", "text"][: len(columns)])

    done = mapped(packed, run, T.StructType(fields))
    back = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in keep]
    return done.select(*back, F.col("stats").alias(name))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rules(s: Column) -> dict[str, Column]:
    """The voting rules over a statistics struct ``s``; each may abstain."""
    words, lines = s["n_words"], s["n_lines"]
    repeat, symbols = ratio(s["n_repeat_words"], words), ratio(s["n_symbols"], words)
    upper, length = ratio(s["n_upper"], s["n_letters"]), ratio(s["word_chars"], words)
    exclaim, copies, top = ratio(s["n_exclaim"], words), ratio(s["n_dup_lines"], lines), ratio(s["n_top_word"], words)
    pipes, marks, dense = ratio(s["n_pipes"], words), ratio(s["n_marks"], s["word_chars"]), ratio(s["n_symbols"], s["word_chars"])
    return {
        "length": vote(words < 50, words >= 80),
        "repetition": vote(repeat > 0.3, repeat < 0.1),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "symbol_share": vote(dense > 0.05, dense < 0.005),
        "marks": vote(marks > 0.2, marks < 0.1),
        "capitals": vote(upper > 0.3, upper < 0.12),
        "exclamation": vote(exclaim > 0.1, exclaim < 0.02),
        "word_length": vote((length < 2) | (length > 14), (length >= 3) & (length <= 10)),
        "copied_lines": vote(copies > 0.3, copies < 0.05),
        "top_word": vote((top > 0.3) & (words >= 20), top < 0.15),
        "fragments": vote(pipes > 0.1, pipes < 0.01),
    }


class LabelModel:
    """Vote likelihoods of each rule for either class, and the share of good documents."""

    def __init__(self, prior: float, chances: np.ndarray):
        self.prior, self.chances = prior, chances  # chances[class, rule, vote + 1], class 1 is good

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        """EM over distinct vote patterns; the starting posterior is the share of good votes.

        Fixed pseudo-counts keep unseen votes possible and hold each rule on
        its own side of chance, so the classes can't swap.
        """
        n_rules = patterns.shape[1]
        hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
        cast = np.abs(patterns).sum(1)
        good = np.where(cast > 0, ((patterns > 0).sum(1) + 0.5) / (cast + 1.0), 0.5)
        soft = np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])[:, None, :]
        chances, prior = np.repeat(soft / soft.sum(2, keepdims=True), n_rules, axis=1), 0.5
        for _ in range(rounds if len(counts) else 0):
            weights = np.stack([counts * (1 - good), counts * good])
            chances = np.einsum("cp,prv->crv", weights, hot) + soft
            chances /= chances.sum(2, keepdims=True)
            prior = float((weights[1].sum() + 1) / (weights.sum() + 2))
            model = cls(prior, chances)
            new = 1 / (1 + np.exp(-model.log_odds(patterns)))
            if np.abs(new - good).max() < 1e-9:
                break
            good = new
        return cls(prior, chances)

    def weights(self) -> np.ndarray:
        """weights[rule, vote + 1]: what a vote adds to the log odds of good; on the rule's own side."""
        w = np.log(self.chances[1]) - np.log(self.chances[0])
        w[:, 0], w[:, 2] = np.minimum(w[:, 0], 0), np.maximum(w[:, 2], 0)
        return w

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        w = self.weights()
        return np.log(self.prior / (1 - self.prior)) + w[np.arange(patterns.shape[1]), patterns + 1].sum(1)

    def probability(self, votes: list[Column]) -> Column:
        """The posterior of good quality as a Spark expression."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for vote_of, (bad, none, good) in zip(votes, self.weights().tolist(), strict=True):
            odds = odds + F.when(vote_of < 0, bad).when(vote_of > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit_label_model(stats: DataFrame, name: str = "stats") -> LabelModel:
    """Fit on all rows of ``stats``: patterns are counted in Spark, at most 3 ** rules rows come back."""
    votes = rules(F.col(name))
    counted = stats.groupBy(*[v.alias(r) for r, v in votes.items()]).count().collect()
    counted = sorted(map(tuple, counted))
    table = np.array(counted, np.int64).reshape(len(counted), len(votes) + 1)
    return LabelModel.fit(table[:, :-1], table[:, -1].astype(float))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def judge(stats: DataFrame, name: str = "stats", threshold: float = 0.5) -> DataFrame:
    """Add probability, base_failed and kept to a frame with a statistics struct."""
    model = fit_label_model(stats, name)
    s = F.col(name)
    p = model.probability(list(rules(s).values()))
    return stats.select("*", p.alias("probability"), base_failed(s).alias("base_failed"), (~base_failed(s) & (p >= threshold)).alias("kept"))


def quality_table(docs: DataFrame) -> DataFrame:
    """Per document doc_id, its statistics, probability and verdict; texts are read once."""
    judged = judge(cut(with_stats(docs, ["doc_id"])))
    return judged.select("doc_id", *[F.col("stats")[x].alias(x) for x in STATS], "probability", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are read twice (to fit, then to filter), which moves nothing, rather
    than shuffled or stored for a join on verdicts.
    """
    fitted = fit_label_model(with_stats(docs, []))
    name = "stats"
    while name in docs.columns:
        name += "_"
    scored = with_stats(docs, docs.columns, name=name)
    s = F.col(name)
    kept = ~base_failed(s) & (fitted.probability(list(rules(s).values())) >= 0.5)
    return scored.where(kept).select(docs.columns)
