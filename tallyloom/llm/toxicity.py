"""Toxicity classifier by weak supervision: many voters, a label model, a hashed linear classifier.

Voters are a fixed lexicon, lexicons learned from separate folds of the labelled rows, and patterns of
their hits. A generative model estimates the voters' accuracies and correlations from the vote
patterns of all documents, with the training labels as known cases. Its posterior labels of a
sample train a linear classifier on hashed word beginnings, which scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import flat_bytes, map_pieces, text_column
from .labelmodel import (
    LabelModel,
    SparseRows,
    fit,
    pattern_key,
    pattern_votes,
    probability,
    train_linear,
)
from .quality import sample
from .shingles import mix

# Labelled rows, those with the least hash of doc_id, that lexicons are learned from.
LABELLED_ROWS = 50_000
# Documents whose posterior labels train the classifier.
SAMPLE_ROWS = 20_000
FOLDS = 5
# Terms of a learned lexicon.
LEXICON_TERMS = 400
# Standard errors that make a feature worth a weight.
SCREEN = 6.0
_FEATURES = 1 << 18
# Bytes of a word's beginning that make a term, beside the whole word.
_LENGTHS = (4, 5, 6, 7, 8)

# Fixed value: common English words of insult and contempt.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "clown", "trash", "garbage", "pathetic",
    "worthless", "disgusting", "imbecile", "jerk", "creep", "pig", "bastard", "hate", "ugly", "freak",
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[ord("a") : ord("z") + 1] = True
_INSIDE[0x80:] = True
_TERM = np.uint64((1 << 48) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all words, and the text each belongs to.

    Words are runs of letters and of bytes beyond ASCII. A term is the beginning of a word, of 4 to 8
    bytes; a shorter word is a term itself.
    """
    data = _LOWER[data]
    inside = _INSIDE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    length = np.flatnonzero(ends) + 1 - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    padded = np.concatenate([data, np.zeros(max(_LENGTHS), np.uint8)]).astype(np.uint64)
    rolled = np.zeros(len(starts), np.uint64)
    terms, owners = [], []
    for i in range(max(_LENGTHS)):
        has = length > i
        rolled = np.where(has, rolled * _BASE + padded[starts + i] + np.uint64(1), rolled)
        if i + 1 in _LENGTHS:
            full = length > i if i + 1 > min(_LENGTHS) else length > 0
            terms.append(mix(rolled[full] + np.minimum(length[full], i + 1).astype(np.uint64) * _BASE))
            owners.append(owner[full])
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(terms), np.concatenate(owners)


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text: term hashes (48 bits kept) and texts, in order of texts.

    A term that stands twice, or three times, in a text gives a further term for that.
    """
    data, offsets = flat_bytes(texts)
    out_terms, out_owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # Texts by the thousand, so that a text's number fits above its 48-bit terms.
    for start in range(0, len(texts), 1 << 15):
        stop = min(len(texts), start + (1 << 15))
        part = offsets[start : stop + 1]
        terms, owner = word_terms(data[part[0] : part[-1]], part - part[0])
        keys, n = np.unique(owner.astype(np.uint64) << np.uint64(48) | terms & _TERM, return_counts=True)
        repeated = [keys]
        for times in (2, 3):
            some = keys[n >= times]
            again = mix((some & _TERM) ^ np.uint64(times)) & _TERM
            repeated.append(some >> np.uint64(48) << np.uint64(48) | again)
        keys = np.sort(np.concatenate(repeated))
        out_terms.append(keys & _TERM)
        out_owner.append((keys >> np.uint64(48)).astype(np.int64) + start)
    return np.concatenate(out_terms), np.concatenate(out_owner)


def lexicon_hashes(words: tuple[str, ...]) -> np.ndarray:
    """Terms that stand for words: a word's longest beginning that is a term."""
    texts = pa.array([w[: max(_LENGTHS)] for w in words])
    data, offsets = flat_bytes(texts)
    terms, owner = word_terms(data, offsets)
    # The last term of a word is its longest.
    return np.unique([terms[owner == i][-1] & _TERM for i in range(len(words))]).astype(np.uint64)


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(label_of, toxic, fold) of at most ``rows`` documents that may be learned from.

    A document with several labels takes the highest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_of")).agg(F.max("toxic").alias("toxic"))
    fold = (F.crc32(F.col("label_of").cast("string").cast("binary")) % FOLDS).cast("int")
    return known.orderBy(F.xxhash64("label_of"), "label_of").limit(rows).withColumn("fold", fold)


def term_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(fold, term, n, n_toxic): in how many labelled documents, and toxic ones, a term stands."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            fold = batch.column(2).to_numpy().astype(np.int64)
            terms, owner = text_terms(text_column(batch, "text"))
            keys, place = np.unique(terms << np.uint64(3) | fold[owner].astype(np.uint64), return_inverse=True)
            return {
                "fold": (keys & np.uint64(7)).astype(np.int32),
                "term": (keys >> np.uint64(3)).astype(np.int64),
                "n": np.bincount(place, minlength=len(keys)),
                "n_toxic": np.bincount(place, toxic[owner], len(keys)).astype(np.int64),
            }

        return work

    # At most LABELLED_ROWS rows of three numbers.
    labelled = docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_of")).select("text", "toxic", "fold")
    counted = map_pieces(labelled, "text", "fold int, term long, n long, n_toxic long", make)
    return counted.groupBy("fold", "term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def learn_lexicons(docs: DataFrame, known: DataFrame, terms: int = LEXICON_TERMS) -> list[np.ndarray]:
    """A lexicon for each fold, learned from the other ones: terms that mark toxic documents.

    A term must stand four times in five in toxic documents, and that must be too surprising, under
    their share of all, to be the best of so many terms by chance. The most surprising ``terms``
    come to the driver.
    """
    folds = known.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic"))
    sizes = {r["fold"]: (r["n"], r["n_toxic"]) for r in folds.collect()}
    counts = materialise(term_counts(docs, known).filter(F.col("n_toxic") > 0), "toxic-terms")
    n_terms = counts.select("term").distinct().count()
    lexicons = []
    for fold in range(1, FOLDS):
        n = sum(v[0] for k, v in sizes.items() if k != fold)
        n_toxic = sum(v[1] for k, v in sizes.items() if k != fold)
        if not 0 < n_toxic < n:
            lexicons.append(np.zeros(0, np.uint64))
            continue
        base = float(n_toxic) / n
        others = counts.filter(F.col("fold") != fold).groupBy("term")
        share = F.least(F.col("n_toxic") / F.col("n"), F.lit(1 - 1e-9))
        surprise = F.col("n") * (
            share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base))
        )
        found = (
            others.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
            .withColumn("surprise", surprise)
            .filter((share >= max(0.8, base)) & (F.col("surprise") >= np.log(max(n_terms, 1)) + 3))
            .orderBy(F.desc("surprise"), "term")
            .limit(terms)
            .collect()
        )
        lexicons.append(np.unique(np.array([r["term"] for r in found], np.uint64)))
    return lexicons


class Voters:
    """Votes on texts: 1 toxic, 0 clean, 2 no vote.

    One voter for each lexicon, two for patterns: several different hits, and dense hits.
    """

    def __init__(self, lexicons: list[np.ndarray]):
        self.lexicons = lexicons
        self.n = len(lexicons) + 2

    def cast(self, texts: pa.Array) -> np.ndarray:
        terms, owner = text_terms(texts)
        n = len(texts)
        n_terms = np.bincount(owner, minlength=n)
        union = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.lexicons]))
        hit = np.isin(terms, union)
        terms, owner = terms[hit], owner[hit]
        votes = []
        for lexicon in self.lexicons:
            found = np.bincount(owner[np.isin(terms, lexicon)], minlength=n) > 0
            # A lexicon without terms has nothing to say; a text without words gives nothing to judge.
            votes.append(np.where((n_terms > 0) & (len(lexicon) > 0), found.astype(int), 2))
        hits = np.bincount(owner, minlength=n)
        votes.append(np.where(hits >= 4, 1, np.where((hits == 0) & (n_terms > 0), 0, 2)))
        dense = hits / np.maximum(n_terms, 1)
        votes.append(np.where(dense >= 0.02, 1, np.where((dense < 0.001) & (n_terms > 0), 0, 2)))
        return np.stack(votes, axis=1)


def hashed_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text's features, and their numbers."""
    terms, owner = text_terms(texts)
    place = (mix(terms) % np.uint64(_FEATURES)).astype(np.int64)
    return place, np.bincount(owner, minlength=len(texts))


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float, labeller: LabelModel | None = None):
        self.weights, self.bias, self.labeller = weights.astype(np.float32), bias, labeller

    def score(self, texts: pa.Array) -> np.ndarray:
        place, counts = hashed_terms(texts)
        rows = SparseRows(place, np.ones(len(place), np.float32), counts)
        return probability(rows.dot(self.weights) + self.bias)


def _with_labels(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, label): 2 where there is no label to learn from."""
    joined = docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_of"), "left")
    return joined.select("text", F.coalesce(F.col("toxic").cast("int"), F.lit(2)).alias("label"))


def _patterns(docs: DataFrame, known: DataFrame, voters: Voters) -> list:
    """Rows (label or 2, pattern, n) over all documents; at most 3 ** voters.n patterns a label."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            label = batch.column(1).to_numpy().astype(np.int64)
            keys = pattern_key(voters.cast(text_column(batch, "text"))) * 3 + label
            found, n = np.unique(keys, return_counts=True)
            return {"label": found % 3, "pattern": found // 3, "n": n}

        return work

    return (
        map_pieces(_with_labels(docs, known), "text", "label long, pattern long, n long", make)
        .groupBy("label", "pattern")
        .agg(F.sum("n").alias("n"))
        .collect()
    )


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); held-out labels are not read."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = training_labels(labels)
    voters = Voters([lexicon_hashes(INSULTS), *learn_lexicons(docs, known)])
    found = _patterns(docs, known, voters)
    if not found:
        return ToxicityModel(np.zeros(_FEATURES), -3.0)
    keys = np.unique([r["pattern"] for r in found]).astype(np.int64)
    place = {k: i for i, k in enumerate(keys)}
    table = np.zeros((len(keys), 3))
    for r in found:
        table[place[r["pattern"]], r["label"]] += r["n"]
    votes = pattern_votes(keys, voters.n)
    first = np.where((votes == 1).any(1), 0.9, 0.05)
    labeller = fit(votes, table[:, 2], np.stack([1 - first, first], axis=1), known=table[:, :2], correlated=True)

    sampled = materialise(sample(docs, rows), "toxic-sample")
    return ToxicityModel(*_train_classifier(sampled, voters, labeller), labeller)


def _train_classifier(docs: DataFrame, voters: Voters, labeller: LabelModel) -> tuple[np.ndarray, float]:
    """Fit weights of hashed terms and a bias to the posterior labels of ``docs``.

    Given labels are read by the lexicons and the label model only, so that the classifier learns the
    same way whatever share of the documents has one.

    Long texts would gather weight by chance from many features without evidence. So features
    are first screened by how far their texts' labels lie from the average in standard errors,
    then a lasso chooses among them, and the chosen ones are fitted without its shrinkage.
    """

    def targets(texts: pa.Array) -> np.ndarray:
        return labeller.posterior(voters.cast(texts))

    def make_counts():
        def work(batch: pa.RecordBatch) -> dict:
            texts = text_column(batch, "text")
            target = targets(texts)
            place, counts = hashed_terms(texts)
            found, at = np.unique(place, return_inverse=True)
            sums = np.bincount(at, np.repeat(target, counts), len(found))
            # The last row counts the texts themselves.
            return {
                "place": np.append(found, -1),
                "n": np.append(np.bincount(at, minlength=len(found)), len(texts)),
                "toxic": np.append(sums, target.sum()),
            }

        return work

    evidence = materialise(
        map_pieces(docs, "text", "place long, n long, toxic double", make_counts)
        .groupBy("place")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")),
        "toxic-evidence",
    )
    total = evidence.filter("place = -1").first()
    mean = total["toxic"] / total["n"] if total else 0.0
    bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    weights = np.zeros(_FEATURES)
    spread = F.sqrt(F.col("n") * mean * (1 - mean))
    strong = F.abs(F.col("toxic") - F.col("n") * mean) >= SCREEN * spread
    kept = np.array(sorted(r["place"] for r in evidence.filter((F.col("place") >= 0) & strong).collect()), np.int64)
    if not 0 < mean < 1 or not len(kept):
        return weights, bias

    def make_rows():
        def work(batch: pa.RecordBatch) -> dict:
            texts = text_column(batch, "text")
            place, counts = hashed_terms(texts)
            owner = np.repeat(np.arange(len(texts)), counts)
            own = np.isin(place, kept)
            cuts = np.searchsorted(owner[own], np.arange(1, len(texts)))
            packed = [np.searchsorted(kept, p).astype("<i4").tobytes() for p in np.split(place[own], cuts)]
            return {"target": targets(texts), "place": packed}

        return work

    sampled = map_pieces(docs, "text", "target double, place binary", make_rows).collect()
    target = np.array([r["target"] for r in sampled])
    places = [np.frombuffer(r["place"], "<i4") for r in sampled]
    counts = np.array([len(p) for p in places], np.int64)
    flat = np.concatenate(places).astype(np.int64)
    chosen = np.arange(len(kept))
    for lasso, ridge in ((1e-3, 0.0), (0.0, 1e-5)):
        at = np.full(len(kept), -1)
        at[chosen] = np.arange(len(chosen))
        used = at[flat] >= 0
        n = np.bincount(np.repeat(np.arange(len(counts)), counts)[used], minlength=len(counts))
        rows = SparseRows(at[flat][used], np.ones(int(used.sum())), n)
        found, bias = train_linear(rows, target, len(chosen), lasso=lasso, ridge=ridge, rounds=400)
        weights[:] = 0
        weights[kept[chosen]] = found
        chosen = chosen[found != 0]
    return weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if score is 0.5 or more).

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other columns are ignored, and a
    score depends on the text alone. A NULL text is an empty one, which gets the model's base
    score. Without labels the fixed lexicon alone is learned from. Rows without a doc_id are
    not held out. An empty table gives an empty table.
    """
    model = model or train_toxicity(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            score = shared.value.score(text_column(batch, "text"))
            return {"doc_id": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return work

    scored = map_pieces(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, score double, predicted int", make
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
