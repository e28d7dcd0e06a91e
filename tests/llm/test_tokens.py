"""Segment files, SentencePiece pieces and the words of the library, against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import pieces, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")

MIXED = [
    "a", "b", "th", "er", " ", "  ", "▁", "\n", "é", "中", "😀", "\x00", "the", "!!", "***", "1", "22",
    "'s", "'T", "don't", "<|endoftext|>", "<|", "é", "́", "İ", "ﬁ", "=", "̸", "»", " ",
    " ", "aaaa", "<s>", "<0x0A>", "\t",
]


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path


def texts(n: int = 600) -> list[str]:
    rng = random.Random(7)
    made = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return ["", " ", "\n\n", "▁", "a" * 700, " " * 77, "ab" * 400, "word " * 30_000, *made]


def test_words_match_the_library(vocabulary):
    words = tokenfile.load_tokenizer(vocabulary("word_bpe_49k.json"))
    ids, at = words.encode(pa.array(texts()), 1)
    for text, a, b in zip(texts(), at[:-1], at[1:]):
        assert ids[a:b].tolist() == words.library.encode(text, add_special_tokens=False).ids + [1]


def test_pieces_match_the_library(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    model = pieces.load_model(vocabulary("piece_bpe_32k.model"))
    ids, at = model.encode(pa.array(texts()))
    decoded = model.decode(ids, at)
    for text, a, b, back in zip(texts(), at[:-1], at[1:], decoded):
        assert ids[a:b].tolist() == [1, *library.encode(text), 2]
        assert back == library.decode(ids[a:b].tolist())


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5_000])
@pytest.mark.parametrize("top", [0, 40, 10**6, 10**15])
def test_elias_fano_returns_every_number(n, top):
    rng = random.Random(n)
    values = np.sort(np.array([rng.randint(0, top) for _ in range(n)], np.uint64))
    coded = tokenfile.EliasFano.encode(values, top)
    stored = coded.to_bytes()
    back = tokenfile.EliasFano.from_bytes(memoryview(stored))
    assert back.values().tolist() == values.tolist()
    assert [back.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    if n >= 300 and top >= n:
        assert 8 * len(stored) <= n * (3 + np.log2(top / n + 1)) + n / 8 + 400
    with pytest.raises(IndexError):
        back.select(n)


def rows(spark, data, schema="doc_id long, text string, start string"):
    return spark.createDataFrame([(*r, "x") for r in data], schema)


def expected_segments(library, data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    at, out = 0, []
    for doc_id, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        out.append((doc_id, at, len(ids), zlib.crc32(raw)))
        at += len(ids)
    return out


def test_segment_files_round_trip(spark, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    data = [(None, "no id"), (5, None), (-3, ""), (2**62, "far away"), *enumerate(texts(60), 10)]
    written = tokenfile.write_segments(rows(spark, data).repartition(5), path)
    got = [tuple(r) for r in tokenfile.read_documents(spark, written).collect()]
    library = tokenfile.load_tokenizer(path).library
    assert sorted(got, key=repr) == sorted(expected_segments(library, data), key=repr)


def test_segment_files_with_repeated_ids_and_small_segments(spark, vocabulary, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    data = [(1, "same text here"), (1, "same text here"), (1, "other"), (2, "b")]
    written = tokenfile.write_segments(rows(spark, data), path, end_id=None)
    got = sorted(tuple(r) for r in tokenfile.read_documents(spark, written).collect())
    assert [r[0] for r in got] == [1, 1, 1, 2]
    starts, sizes = [r[1] for r in got], [r[2] for r in got]
    assert starts == [0, *np.cumsum(sizes)[:-1].tolist()]
    stored = spark.read.parquet(written).collect()
    segment = tokenfile.Segment.from_bytes(stored[0]["payload"])
    assert segment.document(0).tolist() == segment.ids[: segment.starts.select(1)].tolist()


def test_empty_tables(spark, vocabulary):
    none = rows(spark, [])
    written = tokenfile.write_segments(none, vocabulary("word_bpe_49k.json"))
    assert tokenfile.read_documents(spark, written).collect() == []
    assert pieces.token_digests(none, vocabulary("piece_bpe_32k.model")).collect() == []


def test_piece_documents_and_digests(spark, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    data = [(None, "no id"), (5, None), (5, None), (6, ""), (7, "two  words\n"), (8, "x" * 9_000)]
    encoded = pieces.encode_documents(rows(spark, data), path)
    back = pieces.decode_documents(encoded, path)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(
        ((d, t or "") for d, t in data), key=repr
    )
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for row in pieces.token_digests(rows(spark, data), path).collect():
        raw = np.array(ids[row["doc_id"]], "<u4").tobytes()
        assert row["n_tokens"] == len(raw) // 4
        assert row["ids_sha256"] == hashlib.sha256(raw).hexdigest()
