"""Drawing the documents that look most like a target corpus: importance resampling.

Words and pairs of words fall into hashed buckets. How much likelier a bucket is in the target than in
the source is its gain, and the gains of all buckets are one small array that scores every document. A
hash of the document's id adds Gumbel noise, so the highest scores are a draw without replacement.

The cutoff of the draw is located without sorting all rows: a quantile sketch of the scores proposes
a bracket, exact counts of rows above and inside validate it or widen it, and only the rows of the
bracket are sorted. The rows drawn are numbered over ranges of the order (``with_positions``).
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import with_positions
from ..session import materialise
from .common import flat_bytes, map_pieces, pieces, text_column

BUCKETS = 10_000
# Bytes that are part of a word: digits, letters, and all of characters beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# Longer words go through zlib one by one, the others byte place by byte place.
_LONG = 48
# First half width of the bracket, as a share of all rows; each round makes it 8 times as wide.
FIRST_WIDTH = 0.002


@functools.cache
def _crc_table() -> np.ndarray:
    """Remainders of all bytes by the reversed polynomial of CRC-32."""
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each word of lowered bytes; no word spans two texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _INSIDE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    # A word ends before a byte that is not inside, or before the next text.
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends - starts


def _advance(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray
) -> np.ndarray:
    """CRC-32 register states (not inverted) after each word, all words at once."""
    table, out = _crc_table(), states.copy()
    short = np.flatnonzero(lengths <= _LONG)
    # Longest first: words that still have a byte at some place are a prefix of the order.
    order = short[np.argsort(-lengths[short], kind="stable")]
    state, at, left = out[order], starts[order], lengths[order]
    open_ = np.searchsorted(-left, -np.arange(1, _LONG + 1), side="right")
    for place, n in enumerate(open_.tolist()):
        if not n:
            break
        byte = data[at[:n] + place]
        state[:n] = (state[:n] >> np.uint32(8)) ^ table[(state[:n] ^ byte) & np.uint32(0xFF)]
    out[order] = state
    whole = data.data
    for i in np.flatnonzero(lengths > _LONG).tolist():
        crc = int(states[i]) ^ 0xFFFFFFFF
        end = int(starts[i] + lengths[i])
        out[i] = zlib.crc32(whole[int(starts[i]) : end], crc) ^ 0xFFFFFFFF
    return out


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, then of all pairs; the text of each; and words of each text."""
    raw, offsets = flat_bytes(texts)
    data = _LOWER[raw]
    starts, lengths = word_spans(data, offsets)
    words = np.diff(np.searchsorted(starts, offsets))
    of_word = np.repeat(np.arange(len(words)), words)
    fresh = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    states = _advance(data, starts, lengths, fresh)
    pair = np.flatnonzero(of_word[1:] == of_word[:-1])
    blank = (states[pair] >> np.uint32(8)) ^ _crc_table()[(states[pair] ^ np.uint32(0x20)) & np.uint32(0xFF)]
    pairs = _advance(data, starts[pair + 1], lengths[pair + 1], blank)
    crcs = np.concatenate([states, pairs]) ^ np.uint32(0xFFFFFFFF)
    return crcs % np.uint32(BUCKETS), np.concatenate([of_word, of_word[pair]]), words


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of ``docs`` (text); a NULL text has none.

    Each task adds up its own rows in an array and sends its filled buckets; 10,000 sums come to
    the driver, however large the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, "text"):
            total += np.bincount(feature_buckets(text_column(batch, "text"))[0], minlength=BUCKETS)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": filled.astype(np.int32), "n": total[filled]})

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of the id, rounded down."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight and score; all rows, nothing shuffled.

    ``docs`` needs doc_id and text, ``target`` text. The weight is the mean gain of the features,
    rounded down, 0 without any. Texts are read once to count and once to score.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            buckets, owner, words = feature_buckets(text_column(batch, "text"))
            # Whole numbers below 2 ** 53, so these sums of doubles are exact.
            sums = np.bincount(owner, gains[buckets], batch.num_rows).astype(np.int64)
            features = words + np.maximum(words - 1, 0)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            doc_id = batch.column(batch.schema.names.index("doc_id"))
            return {"doc_id": doc_id, "n_words": words, "n_features": features, "weight": weight}

        return work

    schema = "doc_id long, n_words long, n_features long, weight long"
    scored = map_pieces(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, make)
    return scored.withColumn("score", F.col("weight") + _noise(seed))


def bracket(scores: DataFrame, n: int, wanted: int) -> tuple[int, int, int]:
    """Scores (low, high) that hold the ``wanted``-th highest of ``n`` rows, and the rows above high.

    A sketch proposes both ends; rows above and inside are counted exactly. A bracket that misses
    is made wider until it holds the place; at last it holds every row.
    """
    width, place = FIRST_WIDTH, 1 - (wanted - 0.5) / n
    while True:
        ends = [max(0.0, place - width), min(1.0, place + width)]
        # The sketch is as fine as the bracket, so its size does not grow with the table.
        accuracy = int(min(10_000, 4 / width)) + 1
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy).alias("at")).first()["at"]
        low = None if ends[0] == 0.0 else low
        high = None if ends[1] == 1.0 else high
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, below = scores.agg(F.count_if(over), F.count_if(under)).first()
        if above < wanted <= n - below:
            return low, high, above
        width *= 8


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def draw_cutoff(scores: DataFrame, n: int, wanted: int) -> tuple | None:
    """The last row drawn, as (score, doc_id, n_features); None if none is drawn.

    Rows in order of score from the highest, ties to the smaller doc_id, then to fewer features; a row
    without doc_id comes after those with one.
    """
    if wanted < 1:
        return None
    low, high, above = bracket(scores, n, wanted)
    inside = scores
    if low is not None:
        inside = inside.filter(F.col("score") >= low)
    if high is not None:
        inside = inside.filter(F.col("score") <= high)
    placed = with_positions(inside, _order())
    found = placed.filter(F.col("position") == wanted - above).first()
    return found["score"], found["doc_id"], found["n_features"]


def draw_by_importance(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank (NULL: not drawn).

    ``docs`` needs doc_id and text, ``target`` text; other columns are ignored. Of the N rows with at
    least ``min_words`` words, the floor(``percent`` * N / 100) with the highest scores are drawn, in
    the order of ``draw_cutoff``. A NULL text is an empty one. Rows with one doc_id stay separate and
    share their noise; rows equal in doc_id and score beyond the cutoff differ in nothing. An empty
    table gives an empty table, an empty target weights by rarity alone.
    """
    scores = materialise(importance_scores(docs, target, seed), "importance-scores")
    eligible = scores.filter(F.col("n_words") >= min_words)
    n = eligible.count()
    wanted = percent * n // 100
    cutoff = draw_cutoff(eligible, n, wanted)
    names = ("doc_id", "n_features", "weight", "score")
    if cutoff is None:
        return scores.select(*names, F.lit(None).cast("long").alias("rank"))
    score, doc_id, n_features = cutoff
    fewer = F.col("n_features") <= n_features
    if doc_id is None:
        not_after = F.col("doc_id").isNotNull() | fewer
    else:
        not_after = (F.col("doc_id") < doc_id) | ((F.col("doc_id") == doc_id) & fewer)
    drawn = (F.col("score") > score) | ((F.col("score") == score) & F.coalesce(not_after, F.lit(False)))
    drawn = drawn & (F.col("n_words") >= min_words)
    placed = with_positions(scores.filter(drawn), _order(), "rank")
    # Rows equal to the last one drawn are ranked behind it; those beyond the number are not drawn.
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    rest = scores.filter(~drawn)
    return placed.select(*names, rank).unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))
