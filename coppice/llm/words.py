"""Words and word shingles of whole Arrow text columns, without a Python loop per word.

A word is a maximal run of bytes other than space and U+0009..U+000D.  Words and
shingles are represented by 64-bit hashes that depend on nothing but the words.
Bytes are looked at in pieces of PIECE, so a text of any length costs about its
own size and some 40 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE = 1 << 17
_BASE = 0xD1342543DE82EF95
_STEP = np.uint64(0x9FB21C651E98DF25)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int) -> np.ndarray:
    p = np.full(PIECE + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Words:
    """The words of a text column: their byte ranges, and the row each belongs to."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        held = raw.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]
        self.starts, self.ends = self._edges()
        #: Words of row r: first[r] up to first[r + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end; the end of a row ends a word."""
        borders = np.unique(self.offsets[1:-1])
        starts, ends = [], []
        for at in range(0, len(self.data), PIECE):
            until = min(at + PIECE, len(self.data))
            inside = np.zeros(until - at + 2, bool)  # one byte before and one after
            inside[1:-1] = ~SPACE[self.data[at:until]]
            inside[0] = at > 0 and not SPACE[self.data[at - 1]]
            inside[-1] = until < len(self.data) and not SPACE[self.data[until]]
            begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
            cut = borders[np.searchsorted(borders, at) : np.searchsorted(borders, until, side="right")] - at
            first = cut[cut < until - at]
            begin[first] = inside[1:-1][first]
            last = cut[cut > 0] - 1
            end[last] = inside[1:-1][last]
            starts.append(np.flatnonzero(begin) + at)
            ends.append(np.flatnonzero(end) + at + 1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ends])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash a word: a polynomial over its bytes, from prefix sums modulo 2^64 within a piece."""
        out = np.zeros(len(self.starts), np.uint64)
        sums = np.zeros(PIECE + 1, np.uint64)
        word = 0
        with np.errstate(over="ignore"):
            while word < len(out):
                at = int(self.starts[word])
                until = int(np.searchsorted(self.ends, at + PIECE, side="right"))  # words that end in this piece
                if until == word:
                    out[word] = self._long_hash(at, int(self.ends[word]))
                    word += 1
                    continue
                n = int(self.ends[until - 1]) - at
                np.cumsum(_BYTE[self.data[at : at + n]] * _UP[:n], out=sums[1 : n + 1])
                start = self.starts[word:until] - at
                out[word:until] = (sums[self.ends[word:until] - at] - sums[start]) * _DOWN[start]
                word = until
        return mix(out)

    def _long_hash(self, start: int, end: int) -> np.uint64:
        """The same polynomial over a word longer than a piece."""
        total = 0
        for at in range(start, end, PIECE):
            part = self.data[at : min(at + PIECE, end)]
            total += int((_BYTE[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - start, 1 << 64)
        return np.uint64(total % (1 << 64))

    def shingles(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``width``-word windows, and for each row where its windows begin.

        Rows with fewer words have no window.
        """
        h = self.hashes() if hashes is None else hashes
        n = max(0, len(h) - width + 1)
        windows = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                windows *= _STEP
                windows += h[k : k + n]
        per_row = np.maximum(self.counts() - width + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(per_row)])
        # Windows that cross a row's end are left out.
        whole = np.zeros(n + 1, np.int32)
        some = per_row > 0
        np.add.at(whole, self.first[:-1][some], 1)
        np.add.at(whole, self.first[:-1][some] + per_row[some], -1)
        return mix(windows[np.cumsum(whole[:n], dtype=np.int32).astype(bool)]), bounds

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Per row its sorted distinct shingles; the whole sequence as one where it has fewer words."""
        h = self.hashes()
        windows, bounds = self.shingles(width, h)
        sets = []
        for row, n in enumerate(self.counts()):
            if 0 < n < width:
                v = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[self.first[row] : self.first[row + 1]]:
                        v = v * _STEP + x
                sets.append(mix(np.array([v], np.uint64)))
            else:
                sets.append(np.unique(windows[bounds[row] : bounds[row + 1]]))
        return sets
