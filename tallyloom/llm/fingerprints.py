"""Document fingerprints: one-permutation MinHash over word shingles.

Every shingle is hashed once; the top bits of its hash name a bin and the rest compete for the least
value in it. An empty bin takes the value of another bin, tried in an order that depends on the
bin alone (optimal densification). The fingerprint keeps the low bits of each bin's value, and
likeness corrects for values that agree in those bits by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, pieces
from .order import ranged
from .shingles import mix, shingle_hashes

BINS = 256
BITS = 4
_VALUE_BITS = np.uint64(40)
_BIN_BITS = np.uint64(BINS.bit_length() - 1)


def sketch(texts: pa.Array) -> np.ndarray:
    """Low bits of every bin, a row for each text; -1 throughout for a text without words."""
    data, offsets = flat_bytes(texts)
    hashes, counts = shingle_hashes(data, offsets, lower=False)
    n = len(texts)
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(counts))
    # One sort by text, bin and value; the first of each bin is its minimum.
    keys = np.sort(owner << np.uint64(48) | hashes >> np.uint64(16))
    cells = keys >> _VALUE_BITS
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
    filled = np.zeros(n * BINS, bool)
    values = np.zeros(n * BINS, np.uint64)
    cells = cells[first].astype(np.int64)
    filled[cells] = True
    values[cells] = mix(keys[first] & ((np.uint64(1) << _VALUE_BITS) - np.uint64(1)))
    filled, values = filled.reshape(n, BINS), values.reshape(n, BINS)
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.int8)
    empty = ~filled.any(axis=1)
    rows, bins = np.nonzero(~filled & ~empty[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        tried = mix(bins.astype(np.uint64) << np.uint64(32) | np.uint64(attempt)) % np.uint64(BINS)
        tried = tried.astype(np.int64)
        hit = filled[rows, tried]
        low[rows[hit], bins[hit]] = low[rows[hit], tried[hit]]
        rows, bins = rows[~hit], bins[~hit]
    low[empty] = -1
    return low


def pack(low: np.ndarray) -> list[str]:
    """Fingerprints as hex text, ``BITS`` bits for each bin; empty for a text without words."""
    known = np.maximum(low, 0).astype(np.uint8)
    bits = np.unpackbits(known[:, :, None], axis=2, bitorder="little", count=BITS)
    raw = np.packbits(bits.reshape(len(low), -1), axis=1)
    return [r.tobytes().hex() if v >= 0 else "" for r, v in zip(raw, low[:, 0])]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, row by row, from 0 to 1.

    Two texts without words are alike (1); one of them is unlike any other text (0).
    """
    agree = (left == right).mean(axis=1)
    chance = 1.0 / (1 << BITS)
    value = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    one_empty = (left[:, 0] < 0) != (right[:, 0] < 0)
    return np.where(one_empty, 0.0, value)


def edited(text: str, following: str) -> str:
    """The text with its last third, rounded down, replaced by the start of the next."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, guest, doc_id, text), sorted so that every document is followed by its next.

    Documents are in descending order of doc_id, those without one last, repeated ids by a hash of
    the text. Each range ends with a guest, the first document of the range after it;
    the last range has the very first one. There are at most ``order.MAX_RANGES`` ranges and as
    many first documents, so these are broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ranged(rows, docs.count()).withColumn("tie", F.xxhash64("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("tie").alias("tie"))
    heads = rows.groupBy("range").agg(F.min(rank).alias("head"))
    cycle = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    heads = heads.select(
        F.coalesce(F.lag("range").over(cycle), last).alias("host"),
        F.col("range").alias("of"),
        F.col("head"),
    )
    is_head = (F.col("range") == F.col("of")) & (rank == F.col("head"))
    visits = F.when(
        F.col("host").isNotNull(),
        F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))),
    ).otherwise(F.array(F.struct("range", F.lit(False).alias("guest"))))
    placed = rows.join(F.broadcast(heads), is_head, "left").select(
        F.explode(visits).alias("visit"), "doc_id", "tie", "text"
    )
    return (
        placed.select("visit.*", "doc_id", "tie", "text")
        .repartition("range")
        .sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "tie")
        .drop("tie")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edit with the next document, and their likeness.

    ``docs`` needs doc_id and text; other columns are ignored. A NULL text is an empty one; a text
    without words has an empty fingerprint. Rows with the same doc_id follow each other in
    the order of a hash of their texts, rows without one come last. A lone document is its own
    next. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in pieces(batches, "text"):
            held += zip(*(c.to_pylist() for c in batch.columns))
            done, held = held[:-1], held[-1:]
            if done:
                yield _fingerprints(done, held[0])
        # A range ends with a guest, so the row held last of all is one.

    return _with_next(docs).mapInArrow(run, SCHEMA)


def _fingerprints(rows: list[tuple], after: tuple) -> pa.RecordBatch:
    """Columns for rows (range, guest, doc_id, text), each followed by the next, the last by ``after``."""
    all_rows = [*rows, after]
    low = sketch(pa.array([r[3] for r in all_rows], pa.large_string()))
    own = [i for i, r in enumerate(rows) if not r[1]]
    edits = [edited(rows[i][3], all_rows[i + 1][3]) for i in own]
    low_edit = sketch(pa.array(edits, pa.large_string()))
    here, there = low[own], low[[i + 1 for i in own]]
    columns = [
        pa.array([rows[i][2] for i in own], pa.int64()),
        pa.array([len(rows[i][3]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
        pa.array(pack(here), pa.string()),
        pa.array(pack(low_edit), pa.string()),
        pa.array(likeness(here, low_edit), pa.float64()),
        pa.array(likeness(here, there), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
