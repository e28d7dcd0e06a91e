"""Importance resampling against plain Python, and the cutoff against a full sort."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import both
from conftest import TEST_DATA
from tallyloom.llm import resample as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = [
    None, "", " .", "One", "one two", "ÀÉ ß日本 x1", "a-b_c`d{e", "x" * 500 + " " + "y" * 49 + " z",
    "é" * 40 + "A " + "q" * 48, " ".join(f"w{i % 37}" for i in range(3_000)), "tail\nof line\x00nul",
]


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plainly(docs, target, percent=25, min_words=20, seed=7):
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([len(words), doc_id, len(found), weight, score, None])
    long = [r for r in rows if r[0] >= min_words]
    long.sort(key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for i, row in enumerate(long[: percent * len(long) // 100]):
        row[5] = i + 1
    return sorted((tuple(r[1:]) for r in rows), key=repr)


def test_buckets_are_those_of_zlib():
    buckets, owner, words = rs.feature_buckets(pa.array(TEXTS).fill_null(""))
    for i, text in enumerate(TEXTS):
        want_words, want = features(text)
        assert words[i] == len(want_words)
        assert Counter(buckets[owner == i].tolist()) == Counter(map(bucket, want))
    empty = rs.feature_buckets(pa.array(["", ""]))
    assert [len(x) for x in empty] == [0, 0, 2]


@pytest.mark.parametrize("percent", [0, 1, 25, 50, 100])
def test_draw_equals_plain_code(spark, percent):
    rng = np.random.default_rng(percent)
    many = [" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) % 90) for _ in range(300)]
    # A hot doc_id, rows without one, repeats, and a clashing column.
    docs = [(int(i) % 70 if i % 3 else 11, t) for i, t in enumerate(TEXTS + many)]
    docs += [(None, many[0] + " more" * 30)] * 5 + [(200, many[1] + " more" * 30)] * 40
    target = [None, "w1 w2 w3", "one two w1 w1"]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    got = rs.draw_by_importance(df, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(docs, target, percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    assert rs.draw_by_importance(docs.limit(0), docs).collect() == []
    got = rs.draw_by_importance(docs, docs.limit(0), 100).collect()
    assert sorted((r.doc_id, r.rank) for r in got) == [(1, 1), (2, None)]


@pytest.mark.parametrize("spread", [1, 7, 5_000])
def test_bracket_holds_the_place_and_little_else(spark, spread):
    n = 20_000
    scores = spark.range(n).select((F.hash("id") % spread).cast("long").alias("score"))
    values = sorted((r.score for r in scores.collect()), reverse=True)
    for wanted in (1, 2, n // 4, n // 2, n - 1, n):
        low, high, above = rs.bracket(scores, n, wanted)
        assert above == (0 if high is None else sum(v > high for v in values))
        assert (low is None or low <= values[wanted - 1]) and (high is None or values[wanted - 1] <= high)
        if spread == 5_000 and n // 4 <= wanted <= n // 2:
            assert sum(low <= v <= high for v in values) < n / 50


def test_a_sketch_that_misses_is_widened(spark, monkeypatch):
    scores = spark.range(5_000).select(F.col("id").alias("score"))
    monkeypatch.setattr(rs, "FIRST_WIDTH", 1e-9)
    low, high, above = rs.bracket(scores, 5_000, 1_000)
    assert low <= 4_000 <= high and above == 4_999 - high


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_query_equals_its_twin(spark):
    got, want = both(spark, "op11_importance_draw", TEST_DATA / "sf0.001")
    assert got == want and len(got) > 100
