"""Token ids of a corpus in segment files with Elias-Fano coded document boundaries.

A segment holds consecutive documents: their ids one after the other, and two Elias-Fano lists,
the documents' ids and the places where their tokens start. Such a list keeps n ascending numbers
below u in about 2 + log2(u / n) bits each and returns any of them through a select structure, so
offsets need no table of 64-bit numbers. Segments are rows of a Parquet table, because
Spark's writers commit those safely on any store and leave out what lost tasks had written.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import flat_bytes, pieces, text_column

# Text that becomes one segment; a longer document is a segment of its own.
SEGMENT_BYTES = 10 << 20
_SAMPLE = 256
_HEAD = struct.Struct("<QQBQ")
_SEGMENT = struct.Struct("<4sBQQQqQQ")


class EliasFano:
    """An ascending list of numbers from 0 to ``top``, with access to each of them."""

    def __init__(self, n: int, top: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits = n, top, low_bits
        self.high, self.low, self.samples = high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        """Low bits are stored as they are, high parts as the places of ones in a bit row."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (top >> low_bits) + 1 if n else 0, bool)
        bits[places] = True
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        return cls(n, top, low_bits, np.packbits(bits, bitorder="little"), np.packbits(low.ravel(), bitorder="little"), places[::_SAMPLE].astype(np.uint32))

    def _low(self, first: int, last: int) -> np.ndarray:
        start, stop = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")
        bits = bits[start % 8 : start % 8 + stop - start].reshape(last - first, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th number: the i-th one of the bit row is sought from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        while True:
            byte = place // 8
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            bits[: place % 8] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                high = 8 * byte + int(ones[left]) - i
                return high << self.low_bits | int(self._low(i, i + 1)[0])
            left -= len(ones)
            place = 8 * (byte + 64)

    def values(self) -> np.ndarray:
        """All numbers."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.top, self.low_bits, len(self.high))
        return head + self.high.tobytes() + self.low.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, top, low_bits, n_high = _HEAD.unpack_from(data)
        n_low = -(-n * low_bits // 8)
        high = np.frombuffer(data, np.uint8, n_high, _HEAD.size)
        low = np.frombuffer(data, np.uint8, n_low, _HEAD.size + n_high)
        samples = np.frombuffer(data, "<u4", -(-n // _SAMPLE), _HEAD.size + n_high + n_low)
        return cls(n, top, low_bits, high, low, samples)


class Segment:
    """Documents and their ids as one byte string.

    Documents are in ascending order of doc_id, those without one first.
    """

    MAGIC = b"TKS1"

    def __init__(self, n_null: int, base: int, doc_ids: EliasFano, starts: EliasFano, ids: np.ndarray):
        self.n_null, self.base, self.doc_ids, self.starts, self.ids = n_null, base, doc_ids, starts, ids

    @staticmethod
    def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
        known = [d for d in doc_ids if d is not None]
        base = known[0] if known else 0
        gaps = np.array([d - base for d in known], np.uint64)
        names = EliasFano.encode(gaps, int(gaps[-1]) if known else 0).to_bytes()
        bounds = EliasFano.encode(starts, int(starts[-1])).to_bytes()
        head = _SEGMENT.pack(Segment.MAGIC, width, len(doc_ids), len(ids), len(doc_ids) - len(known), base, len(names), len(bounds))
        return head + names + bounds + ids.astype(f"<u{width}").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Segment:
        magic, width, _, n_ids, n_null, base, n_names, n_bounds = _SEGMENT.unpack_from(data)
        if magic != cls.MAGIC:
            raise ValueError("not a token segment")
        view, at = memoryview(data), _SEGMENT.size
        names = EliasFano.from_bytes(view[at : at + n_names])
        bounds = EliasFano.from_bytes(view[at + n_names : at + n_names + n_bounds])
        ids = np.frombuffer(data, f"<u{width}", n_ids, at + n_names + n_bounds)
        return cls(n_null, base, names, bounds, ids)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the segment."""
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]

    def all_doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.base + int(g) for g in self.doc_ids.values()]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
# 1: ASCII letters, 2: ASCII marks but for the apostrophe, which joins contractions.
_KIND = np.zeros(256, np.int8)
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_KIND[ord("a") : ord("z") + 1] = 1


class WordTokenizer:
    """Encodes texts with a tokenizer file that lowers case, drops white space and splits words.

    Each distinct word of a batch goes through the tokenizers library once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, one after the other, and the number of words before each.

        Cut at ASCII white space and between ASCII letters and marks, which no token or
        contraction crosses, unless the piece between spaces holds an apostrophe or may
        hold a special token.
        """
        data, offsets = flat_bytes(texts)
        data = _LOWER[data]
        inside, kind = ~_SPACES[data], _KIND[data]
        filled = np.diff(offsets) > 0
        first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
        first[offsets[:-1][filled]] = True
        last[offsets[1:][filled] - 1] = True
        first[1:] |= ~inside[:-1]
        last[:-1] |= ~inside[1:]
        first &= inside
        last &= inside
        edge = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        special = (data[1:] == ord("|")) & (data[:-1] == ord("<"))
        whole = np.flatnonzero((data == ord("'")) | np.append(special, False))
        if len(whole):
            begins, ends = np.flatnonzero(first), np.flatnonzero(last)
            for i in np.unique(np.searchsorted(begins, whole, side="right") - 1):
                edge[begins[i] : ends[i]] = False
        edge &= inside[1:] & inside[:-1] & ~first[1:]
        first[1:] |= edge
        last[:-1] |= edge
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Every second range of these bounds is a word; the others lie between words.
        bounds = np.empty(2 * len(begins), np.int64)
        bounds[0::2], bounds[1::2] = begins, ends
        if not len(begins):
            return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
        both = pa.LargeStringArray.from_buffers(2 * len(begins) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
        return both, np.searchsorted(begins, offsets)

    def encode_distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word starts."""
        ids, owners = [], []
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        done = 0
        for group, coded in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
            ids.append(np.array(coded.ids, np.int64))
            places = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            owners.append(np.searchsorted(starts, places, side="right") - 1 + done)
            done += len(group)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return flat, np.searchsorted(owner, np.arange(len(words) + 1))

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and where each text starts (and the last ends)."""
        both, before = self.words(texts)
        coded = both.dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[0::2]
        used, place = np.unique(place, return_inverse=True)
        ids, at = self.encode_distinct(coded.dictionary.take(pa.array(used)).to_pylist())
        lengths = np.diff(at)[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        extra = 0 if end_id is None else 1
        starts = ends[before] + extra * np.arange(len(before))
        out = np.full(int(starts[-1]), end_id or 0, np.int64)
        total = int(ends[-1])
        source = np.arange(total) + np.repeat(at[place] - ends[:-1], lengths)
        text = np.repeat(np.arange(len(texts)), np.diff(before))
        out[np.arange(total) + extra * np.repeat(text, lengths)] = ids[source]
        return out, starts


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_segments(docs: DataFrame, tokenizer: str, end_id: int | None = 1, path: str | None = None) -> str:
    """Write the ids of all documents, in ascending doc_id order, and return the path.

    ``docs`` needs doc_id and text; other columns are ignored. A NULL text is an empty one. Rows
    without a doc_id come first; rows with the same one are in the order of a hash of their
    texts. An empty table gives a table without segments. Documents are sorted into ranges of
    doc_id (and of that hash, so that a repeated id may span ranges), which are cut into segments.
    """
    path = path or fresh_path(docs.sparkSession, "token-segments")
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", SEGMENT_BYTES):
            words = load_tokenizer(tokenizer)
            ids, starts = words.encode(text_column(batch, "text"), end_id)
            payload = Segment.to_bytes(batch.column(0).to_pylist(), starts, ids, words.width)
            row = {"part": [part], "segment": [segment], "n_docs": [batch.num_rows], "n_ids": [len(ids)], "payload": [payload]}
            yield pa.RecordBatch.from_pydict(row, schema)
            segment += 1

    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInArrow(
        encode, "part int, segment long, n_docs long, n_ids long, payload binary"
    ).write.parquet(path)
    return path


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, before): the number of ids before each segment.

    Sums by part, then running sums over parts (as many as there are write tasks) and inside each.
    """
    index = spark.read.parquet(path).select("part", "segment", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before_part")
    )
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return (
        index.withColumn("inside", before)
        .join(parts, "part")
        .select("part", "segment", (F.col("before_part") + F.col("inside")).alias("before"))
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of segment files: doc_id, start, n_tokens and the crc32 of the ids.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(c for c in batch.columns)):
                segment = Segment.from_bytes(payload.as_py())
                starts = segment.starts.values().astype(np.int64)
                raw = segment.ids.astype("<u4").tobytes()
                n = len(starts) - 1
                columns = [
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array([number.as_py()] * n, pa.int64()),
                    pa.array(segment.all_doc_ids(), pa.int64()),
                    pa.array(starts[:-1]),
                    pa.array(np.diff(starts)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1], starts[1:])], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(path).select("part", "segment", "payload")
    found = stored.mapInArrow(
        decode, "part int, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(segment_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
