"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20_11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2)
    values += np.uint64(1)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_EXACT, _LOWERED = _byte_values(False), _byte_values(True)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte after the last of each word; no word spans two texts."""
    inside = ~_SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | first[1:])) + 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool
) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word in order, and the number of words before each text (and in all).

    ``lower`` treats A-Z as a-z.
    """
    starts, ends = word_bounds(data, offsets)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    place = np.arange(len(data), dtype=np.int64)
    # Bytes between words are summed with the word before them, as zeros.
    spans = np.diff(np.append(starts, len(data)))
    place[starts[0] :] -= np.repeat(starts, spans)
    place[: starts[0]] = 0
    powers = np.full(int(max(spans.max(), starts[0] + 1)) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = (_LOWERED if lower else _EXACT)[data]
    values[_SPACES[data]] = 0
    values *= powers[place]
    sums = np.add.reduceat(values, starts)
    return mix(sums ^ (lengths.astype(np.uint64) * _STEP)), counts


def shingle_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool, size: int = SHINGLE_WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and the number of them before each text.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    words, counts = word_hashes(data, offsets, lower)
    n_words = np.diff(counts)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_counts = np.concatenate([[0], np.cumsum(n_shingles)])
    if not len(words):
        return np.zeros(0, np.uint64), out_counts
    # Every word starts a shingle of as many words as are left, up to the size.
    left = np.repeat(counts[1:], n_words) - np.arange(len(words))
    taken = np.minimum(left, size)
    place = np.arange(len(words)) - np.repeat(counts[:-1], n_words)
    rolled = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for i in range(size):
        rolled = rolled * _BASE + np.where(taken > i, padded[i : i + len(words)], np.uint64(0))
    rolled = mix(rolled + taken.astype(np.uint64) * _STEP)
    keep = (taken == size) | (place == 0)
    return rolled[keep], out_counts


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, lower: bool, size: int = SHINGLE_WORDS
) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, counts = shingle_hashes(data, offsets, lower, size)
    return [np.unique(hashes[a:b]) for a, b in zip(counts[:-1], counts[1:])]
