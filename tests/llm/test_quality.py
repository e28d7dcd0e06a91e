"""Label models and the quality classifier, on made texts and on held labels."""

from __future__ import annotations

import os
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import labelmodel, quality

TEST_DATA = Path(os.environ.get("TEST_DATA_DIR", "/root/testdata"))


def test_em_finds_accuracies_of_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.85, 0.75, 0.65])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = labelmodel.ABSTAIN
    keys, counts = np.unique(labelmodel.pattern_key(votes), return_counts=True)
    patterns = labelmodel.pattern_votes(keys, 4)
    start = ((patterns == 1).sum(1) > (patterns == 0).sum(1)) * 0.8 + 0.1
    model = labelmodel.fit(patterns, counts, np.stack([1 - start, start], axis=1))
    assert np.abs(model.accuracies(patterns, counts) - right).max() < 0.03
    assert abs(model.shares[1] - 0.3) < 0.03


def test_correlated_voters_are_found():
    rng = np.random.default_rng(2)
    truth = rng.random(30_000) < 0.4
    votes = np.where(rng.random((30_000, 5)) < 0.8, truth[:, None], ~truth[:, None]).astype(int)
    votes[:, 4] = votes[:, 3]
    keys, counts = np.unique(labelmodel.pattern_key(votes), return_counts=True)
    patterns = labelmodel.pattern_votes(keys, 5)
    start = (patterns[:, :3].sum(1) >= 2) * 0.8 + 0.1
    model = labelmodel.fit(patterns, counts, np.stack([1 - start, start], axis=1), correlated=True)
    assert model.parents[4] == 3 or model.parents[3] == 4
    assert np.abs(model.accuracies(patterns, counts) - 0.8).max() < 0.06


def prose(rng, n):
    known = ["the", "river", "was", "cold,", "and", "then", "Anna", "left."]
    return " ".join(rng.choice(known) if rng.random() < 0.5 else f"stone{rng.randrange(400)}" for _ in range(n))


def junk(rng, n, kind):
    words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.randrange(99)}" for _ in range(n)]
    if kind == 0:
        return " ".join(w + "###" for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[: n // 10 + 1] for _ in range(10))


def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 300)), True) for i in range(300)]
    rows += [(1_000 + i, junk(rng, 120, i % 4), False) for i in range(60)]
    return rows


def test_junk_is_told_from_prose(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score boolean")
    got = {r["doc_id"]: r["keep"] for r in quality.score_quality(docs).collect()}
    assert np.mean([got[i] == good for i, _, good in corpus()]) > 0.97
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, keep in got.items() if keep}


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "the river was cold"), (1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (4, "x" * 300_000)]
    got = quality.score_quality(spark.createDataFrame(rows, schema)).collect()
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and by_id[1] == by_id[2] == by_id[3] == 0.0
    assert quality.score_quality(spark.createDataFrame([], schema)).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = pa.array(["a b c.", "", "!!! ###", "é é é"])
    place, value, counts = quality.hashed_features(texts)
    cuts = np.cumsum(counts)[:-1]
    for i, (p, v) in enumerate(zip(np.split(place, cuts), np.split(value, cuts))):
        alone = quality.hashed_features(texts.slice(i, 1))
        assert p.tolist() == alone[0].tolist() and v.tolist() == alone[1].tolist()


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_labels_are_met(spark):
    base = f"{TEST_DATA}/sf0.01"
    scored = quality.score_quality(spark.read.parquet(f"{base}/documents.parquet"))
    rows = scored.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
