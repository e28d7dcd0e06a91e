"""Toxicity classifier: terms, held-out rows, made texts and held-out labels."""

from __future__ import annotations

import os
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import toxicity

TEST_DATA = Path(os.environ.get("TEST_DATA_DIR", "/root/testdata"))


def test_terms_are_word_beginnings_in_any_batch():
    texts = ["Idiot, you", "", "é idioten", "an idio", "x" * 50_000]
    terms, owner = toxicity.text_terms(pa.array(texts))
    for i, text in enumerate(texts):
        assert terms[owner == i].tolist() == toxicity.text_terms(pa.array([text]))[0].tolist()
    idiot = toxicity.lexicon_hashes(("idiot",))[0]
    assert [idiot in terms[owner == i] for i in range(5)] == [True, False, True, False, False]


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()}
    assert got.pop(None) is False
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def corpus(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}o{rng.choice('stv')}" for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(40)] = rng.choice(["zzorker", "idiot", "Qualpfen!"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), 5))
    return docs, labels


def test_learned_terms_are_found(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, fold int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, known).collect()}
    held = [i for i, _, _ in labels if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, f) for i, t, f in labels]
    scores = []
    for rows in (labels, flipped):
        known = spark.createDataFrame(rows, "doc_id long, toxic int, fold int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(df, known).collect()))
    assert scores[0] == scores[1]


def test_classifier_learns_from_posteriors_only(spark, monkeypatch):
    seen, train = [], toxicity.train_linear
    monkeypatch.setattr(toxicity, "train_linear", lambda rows, target, *a, **k: seen.append(target) or train(rows, target, *a, **k))
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    toxicity.train_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int, fold int"))
    assert seen and len(seen[0]) == 300 and all(0 < t < 1 for t in seen[0])


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "you idiot"), (1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000)]
    df = spark.createDataFrame(rows, schema)
    no_labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, no_labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(spark.createDataFrame([], schema), no_labels).collect() == []


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    base = f"{TEST_DATA}/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{base}/documents.parquet"), labels)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03
