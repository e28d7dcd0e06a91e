"""A wavelet matrix over the character classes of many texts at once.

Texts are read as UTF-8 bytes. Every byte belongs to one of a few classes, written as a number of
``LEVELS`` bits. The matrix keeps one bit row for each bit, highest first: behind a row, bytes with
a zero are moved before those with a one, in order. How many bytes of a class stand before any
place then follows from one rank a row, so places and counts need no table for each class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEVELS = 3
# Bits of a class. A byte inside a character is of class CONTINUED alone.
LINE_END, GAP_END, SENTENCE_END = 4, 2, 1
CONTINUED = LINE_END | GAP_END | SENTENCE_END
PLAIN = 0

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

# Classes whose bytes end a unit. What is left behind the last of them is a unit too.
UNITS = {
    "line": (LINE_END, LINE_END | GAP_END),
    "word": (GAP_END, LINE_END | GAP_END),
    "sentence": (LINE_END, LINE_END | GAP_END, SENTENCE_END),
}


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte: line feeds, last blanks of a run, stops before a blank or an end."""
    gap = _GAP[data]
    # What follows a byte is a blank, a byte of another kind, or the end of its text.
    gap_next = np.zeros(len(data), bool)
    gap_next[:-1] = gap[1:]
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    ends = ends[1:]
    out = np.zeros(len(data), np.uint8)
    out[(data & 0xC0) == 0x80] = CONTINUED
    out[data == 0x0A] |= LINE_END
    out[gap & (~gap_next | ends)] |= GAP_END
    out[_STOP[data] & (gap_next | ends)] = SENTENCE_END
    return out


class BitRow:
    """Bits with the number of ones before every place, from a count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of classes below ``2 ** LEVELS``."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.rows = []
        for level in reversed(range(LEVELS)):
            ones = (values >> level) & 1
            self.rows.append(BitRow(ones))
            order = ones.astype(bool)
            values = np.concatenate([values[~order], values[order]])

    def rank(self, value: int, places: np.ndarray) -> np.ndarray:
        """Bytes of a class before each place."""
        first, places = 0, np.asarray(places, np.int64)
        for row, level in zip(self.rows, reversed(range(LEVELS))):
            start, ones = int(row.rank(np.array([first]))[0]), row.rank(places)
            if value >> level & 1:
                first, places = row.zeros + start, row.zeros + ones
            else:
                first, places = first - start, places - ones
        return places - first

    def rank_any(self, values: Sequence[int], places: np.ndarray) -> np.ndarray:
        """Bytes of any of the classes before each place."""
        return sum(self.rank(value, places) for value in values)

    def select_any(
        self, values: Sequence[int], counts: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> np.ndarray:
        """The least place from ``low`` to ``high`` with that many such bytes before it.

        Bisection on ranks, for all queries at once. A query with too few bytes ends at ``high``.
        """
        low, high = low.copy(), high.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) >> 1
            enough = self.rank_any(values, middle) >= counts
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
