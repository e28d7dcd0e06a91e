"""Cuts against plain string code, exact round trips, and the wavelet matrix against counting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from compare import both
from conftest import TEST_DATA
from tallyloom.llm import fillmiddle as fim
from tallyloom.llm.wavelet import WaveletMatrix

UNIT_PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+",
    "sentence": r"(?s)(?:(?![.!?](?=[\t-\r ]|\Z)|\n).)*(?:[.!?](?=[\t-\r ]|\Z)|\n)|(?s:.)+",
}
TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", " \n a  b. c!\n\nd? e.f ",
    "<", "<<S>", "x<P>y", "ends with <", "one<\ntwo<S\nthree", "é\n日本 語.\n😀 x\n", "no end" * 50,
    "a\r\nb\r\n\tc\x0b\x0cd", ("long line " * 400 + "\n") * 30,
]


def plainly(doc_id, text, unit, percent=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(UNIT_PATTERNS[unit].replace("(?s)", "").replace(").)*", ")(?s:.))*"), text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", list(fim.UNITS))
def test_transform_equals_plain_code(unit):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("ab.! \n<SPM>é日", k=rng.randrange(200))) for _ in range(400)]
    ids = [None, *range(len(texts) - 1)]
    for percent, spm in ((100, 50), (60, 0), (0, 50)):
        found = fim.transform(pa.array(texts).fill_null(""), ids, unit, percent, spm, 7)
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            output = found["output"][i]
            got = (found["n"][i], found["form"][i], found["prefix_chars"][i], found["middle_chars"][i], output.decode())
            assert got == plainly(doc_id, text, unit, percent, spm)
            assert fim.restore(found["form"][i], output).decode() == (text or "")


def test_ranks_and_places_equal_counts():
    values = np.random.default_rng(2).integers(0, 8, 1_000).astype(np.uint8)
    matrix, places = WaveletMatrix(values), np.arange(1_001)
    for value in range(8):
        assert matrix.rank(value, places).tolist() == [int((values[:p] == value).sum()) for p in places]
    ends = np.flatnonzero((values == 4) | (values == 6)) + 1
    counts = np.arange(len(ends) + 2)
    found = matrix.select_any((4, 6), counts, np.zeros(len(counts), np.int64), np.full(len(counts), 1_000))
    assert found.tolist() == [0, *ends.tolist(), 1_000]


def test_odd_rows_as_tables(spark):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a\nb", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.fill_middle(docs).collect()
    want = [(d, *plainly(d, t, "line")) for d, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    digests = fim.fill_middle_digests(docs).collect()
    assert {r.restored_sha256 for r in digests} == {hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS}
    assert fim.fill_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fim.fill_middle(docs, unit="page")


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_query_equals_its_twin(spark):
    got, want = both(spark, "op12_fill_middle", TEST_DATA / "sf0.001")
    assert got == want and len(got) > 100
