"""Hot doc_ids, equal rows, extreme ids and clashing names in operators and stages."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints, mixing, simjoin
from tallyloom.llm.common import PIECE_ROWS, pieces
from tallyloom.llm.quality import sample


@pytest.mark.parametrize("hot", [11, None])
def test_samples_hold_no_more_rows_than_they_should(spark, hot):
    ids = F.when(F.col("id") % 3 != 0, F.col("id")).otherwise(F.lit(hot))
    docs = spark.range(30_000).select(ids.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    chosen = sample(docs, 3_000).collect()
    assert len(chosen) == 3_000
    of_hot = sum(r.doc_id == hot for r in chosen)
    assert 850 < of_hot < 1_150
    is_hot = F.col("doc_id").eqNullSafe(F.lit(hot))
    equal = docs.withColumn("text", F.when(is_hot, "same").otherwise(F.col("text")))
    few = sample(equal, 3_000).collect()
    assert len(few) == 3_000 and sum(r.text == "same" for r in few) <= 1
    assert sorted(map(tuple, sample(docs, 3_000).collect()), key=repr) == sorted(map(tuple, chosen), key=repr)
    assert len(sample(docs.limit(7), 3_000).collect()) == 7 and sample(docs.limit(0), 5).collect() == []


def test_equal_rows_are_one_entry_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 64)
    rows = [(5, "the same five words here", "a")] * 1_000 + [(i, "w " * (i % 9), "a" if i % 2 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, weights=(1, 3), share=0.3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
        assert sum(0 < r.taken % r.size for r in own if r.size) <= 1
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names_are_carried_along(spark):
    names = ["__key", "__copy", "__copies", "__source", "__id", "__mark", "__stays", "of", "n"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, f"some words of text number {i // 2} and more of it", "a", *range(i, i + 9)) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[3]], schema)
    kept = simjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[::2]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)


def test_the_least_doc_id(spark):
    rows = [(-(2**63), "a b c"), (2**63 - 1, "d e f g h i"), (0, None), (None, "x")]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_chars for r in got} == {-(2**63): 5, 2**63 - 1: 11, 0: 0, None: 1}


def test_pieces_of_many_short_texts():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a"] * 200_000)})
    sizes = [p.num_rows for p in pieces(iter([batch]), "text")]
    assert sum(sizes) == 200_000 and max(sizes) == PIECE_ROWS < 65_536
