"""Quality classifier without labels: heuristic voters, a model of their accuracies, a linear scorer.

Overlapping heuristics vote on every document. Expectation-maximisation over the vote patterns of
all documents estimates how accurate each is, and the posterior labels of a sample train a linear
scorer on hashed character-class features, which scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, map_pieces, text_column
from .labelmodel import (
    ABSTAIN,
    SparseRows,
    fit,
    pattern_key,
    pattern_votes,
    probability,
    train_linear,
)
from .shingles import mix, word_bounds, word_hashes

# Documents, those with the least hash of doc_id, whose posterior labels train the scorer.
SAMPLE_ROWS = 10_000
_FEATURES = 1 << 12

# Kinds of bytes. Sentence marks are told from other marks.
_LETTER_LOW, _LETTER_UP, _DIGIT, _SPACE, _LINE, _SENTENCE, _HIGH, _MARK = range(8)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LETTER_LOW
_KIND[ord("A") : ord("Z") + 1] = _LETTER_UP
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[0x20, 0x09]] = _SPACE
_KIND[0x0A:0x0E] = _LINE
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _SENTENCE
_KIND[0x80:] = _HIGH
# In features each mark has a kind of its own.
_CODE = _KIND.astype(np.uint64)
_CODE[_KIND == _MARK] = 8 + np.arange((_KIND == _MARK).sum(), dtype=np.uint64)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Shares that the voters judge, per text."""
    data, offsets = flat_bytes(texts)
    kind = _KIND[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(float)

    starts, ends = word_bounds(data, offsets)
    hashes, counts = word_hashes(data, offsets, lower=True)
    n_words = np.diff(counts)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[counts]).astype(float)

    first = np.zeros(len(hashes), bool)
    first[counts[:-1][n_words > 0]] = True
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again &= ~first
    mark = kind == _MARK
    doubled = np.zeros(len(data), bool)
    doubled[1:] = mark[1:] & (data[1:] == data[:-1])
    owner = np.repeat(np.arange(len(texts)), n_words)
    pairs = np.sort(mix(hashes) >> np.uint64(24) | owner.astype(np.uint64) << np.uint64(40))
    new = np.r_[True, pairs[1:] != pairs[:-1]] if len(pairs) else np.zeros(0, bool)
    distinct = np.bincount((pairs[new] >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    lone = (ends - starts == 1) & mark[starts] if len(starts) else np.zeros(0, bool)
    marked = mark[ends - 1] & (ends - starts > 1) if len(starts) else np.zeros(0, bool)
    words = np.maximum(n_words, 1)
    letters = per_text((kind == _LETTER_LOW) | (kind == _LETTER_UP))
    solid = per_text((kind != _SPACE) & (kind != _LINE))
    return {
        "words": n_words.astype(float),
        "letters": letters,
        "marks": per_text(mark) / np.maximum(solid, 1),
        "upper": per_text(kind == _LETTER_UP) / np.maximum(letters, 1),
        "lone": per_word(lone) / words,
        "marked": per_word(marked) / words,
        "doubled": per_text(doubled) / words,
        "again": per_word(again) / np.maximum(words - 1, 1),
        "distinct": distinct / words,
    }


# Voter: statistic, the share that is good up to, the share that is bad from, and what it needs.
VOTERS = (
    ("marks", 0.02, 0.08, "words", 5),
    ("upper", 0.10, 0.30, "letters", 40),
    ("lone", 0.01, 0.10, "words", 10),
    ("marked", 0.02, 0.15, "words", 10),
    ("doubled", 0.02, 0.15, "words", 10),
    ("again", 0.05, 0.20, "words", 20),
)
_DISTINCT = (0.10, 0.20, 100)


def cast_votes(texts: pa.Array) -> np.ndarray:
    """Votes on each text: 1 good, 0 bad, 2 no vote. The last voter judges the vocabulary."""
    found = statistics(texts)
    votes = []
    for name, good, bad, size, least in VOTERS:
        share, enough = found[name], found[size] >= least
        votes.append(np.where(enough & (share >= bad), 0, np.where(enough & (share <= good), 1, ABSTAIN)))
    bad, good, least = _DISTINCT
    share, enough = found["distinct"], found["words"] >= least
    votes.append(np.where(enough & (share <= bad), 0, np.where(enough & (share >= good), 1, ABSTAIN)))
    return np.stack(votes, axis=1)


N_VOTERS = len(VOTERS) + 1


def hashed_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of the features of each text, and their numbers.

    Features are runs of three byte kinds, and words that repeat the one before, hashed into a
    table; values are square roots of their shares of the text.
    """
    data, offsets = flat_bytes(texts)
    sizes = np.diff(offsets)
    code = _CODE[data]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    grams = np.zeros(0, np.uint64)
    if len(code) > 2:
        grams = code[:-2] << np.uint64(14) | code[1:-1] << np.uint64(7) | code[2:]
        whole = owner[:-2] == owner[2:]
        grams, owner = grams[whole], owner[:-2][whole]
    table = (mix(np.arange(1 << 21, dtype=np.uint64)) % np.uint64(_FEATURES - 1)).astype(np.int64)
    cells = owner[: len(grams)] * _FEATURES + table[grams.astype(np.int64)]
    counts = np.bincount(cells, minlength=len(texts) * _FEATURES).reshape(len(texts), _FEATURES)
    shares = counts / np.maximum(sizes[:, None], 1)
    hashes, at = word_hashes(data, offsets, lower=True)
    again = np.concatenate([[0], np.cumsum(np.r_[False, hashes[1:] == hashes[:-1]])]) if len(hashes) else np.zeros(1)
    shares[:, -1] = np.diff(again[at]) / np.maximum(np.diff(at), 1)
    rows, place = np.nonzero(shares)
    return place, np.sqrt(shares[rows, place]), np.bincount(rows, minlength=len(texts))


def _blocks(texts: pa.Array, rows: int = 512):
    for start in range(0, len(texts), rows):
        yield texts.slice(start, rows)


def vote_patterns(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns over all documents and how many documents have each."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            keys, n = np.unique(pattern_key(cast_votes(text_column(batch, "text"))), return_counts=True)
            return {"pattern": keys, "n": n}

        return work

    rows = (
        map_pieces(docs.select("text"), "text", "pattern long, n long", make)
        .groupBy("pattern")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    keys = np.array(sorted(r["pattern"] for r in rows), np.int64)
    counts = {r["pattern"]: r["n"] for r in rows}
    return pattern_votes(keys, N_VOTERS), np.array([counts[k] for k in keys], float)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows (doc_id, text): those with the least hashes of doc_id and text.

    A doc_id that many rows share is thereby no more likely than others, and rows equal in both
    count once. Only hashes are ranked; texts move for the chosen rows alone.
    """
    marked = docs.select("doc_id", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("mark"))
    least = marked.select("mark").distinct().orderBy("mark").limit(rows)
    last = least.agg(F.max("mark")).first()[0]
    if last is None:
        return docs.select("doc_id", "text")
    return marked.filter(F.col("mark") <= last).dropDuplicates(["mark"]).drop("mark")


class QualityModel:
    """Weights of the hashed features; scores are probabilities of good quality."""

    def __init__(self, weights: np.ndarray, bias: float, accuracies: np.ndarray):
        self.weights, self.bias, self.accuracies = weights, bias, accuracies

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for block in _blocks(texts):
            place, value, counts = hashed_features(block)
            score = probability(SparseRows(place, value, counts).dot(self.weights) + self.bias)
            out.append(np.where(statistics(block)["words"] > 0, score, 0.0))
        return np.concatenate(out) if out else np.zeros(0)


def train_quality(docs: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit voters' accuracies on all documents and the scorer on a sample of at most ``rows``."""
    votes, counts = vote_patterns(docs)
    if not len(votes):
        return QualityModel(np.zeros(_FEATURES), 0.0, np.full(N_VOTERS, 0.5))
    # Junk of one kind passes the tests of others, so every voter that casts a bad vote starts a
    # kind of bad documents; documents without one start as good.
    kinds = np.flatnonzero((votes == 0).any(0))
    start = np.concatenate([(votes[:, kinds] == 0) + 0.0, np.full((len(votes), 1), 0.1)], axis=1)
    start /= start.sum(1, keepdims=True)
    labeller = fit(votes, counts, start, classes=(0,) * len(kinds) + (1,))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            places, values, patterns = [], [], []
            for block in _blocks(text_column(batch, "text")):
                place, value, n = hashed_features(block)
                cuts = np.cumsum(n)[:-1]
                places += [p.astype("<i4").tobytes() for p in np.split(place, cuts)]
                values += [v.astype("<f4").tobytes() for v in np.split(value, cuts)]
                patterns.append(pattern_key(cast_votes(block)))
            return {"pattern": np.concatenate(patterns), "place": places, "value": values}

        return work

    schema = "pattern long, place binary, value binary"
    found = map_pieces(sample(docs.select("doc_id", "text"), rows), "text", schema, make).collect()
    target = labeller.posterior(pattern_votes(np.array([r["pattern"] for r in found], np.int64), N_VOTERS))
    place = [np.frombuffer(r["place"], "<i4") for r in found]
    value = [np.frombuffer(r["value"], "<f4") for r in found]
    none = [np.zeros(0, np.int64)]
    data = SparseRows(np.concatenate(place or none), np.concatenate(value or none), np.array([len(p) for p in place], np.int64))
    weights, bias = train_linear(data, target, _FEATURES)
    return QualityModel(weights, bias, labeller.accuracies(votes, counts))


def score_quality(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """Per document: doc_id, score (probability of good quality), keep (score of 0.5 or more).

    ``docs`` needs doc_id and text; other columns are ignored. A text that is NULL or has no
    words scores 0. Equal texts score alike. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train_quality(docs))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            score = shared.value.score(text_column(batch, "text"))
            return {"doc_id": batch.column(0), "score": score, "keep": score >= 0.5}

        return work

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, score double, keep boolean", make)


def keep_good(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_quality`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train_quality(docs))

    def run(batches):
        from .common import pieces

        for batch in pieces(batches, "text"):
            score = shared.value.score(text_column(batch, "text"))
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
