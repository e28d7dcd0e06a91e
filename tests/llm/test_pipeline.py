"""The pipeline and its stages against plain computations over a small table."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import zlib
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tallyloom.llm import mixing, pii, queries, simjoin
from test_simjoin import brute

TEST_DATA = Path(os.environ.get("TEST_DATA_DIR", "/root/testdata"))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.randrange(60)}x" for _ in range(rng.randint(8, 60))]
        words = ["".join(c for c in w if not c.isdigit()) + rng.choice(["a", "en", "or", "ist", "um"]) for w in words]
        kind = rng.random()
        if kind < 0.1:
            words = [w + "###" for w in words * 2]
        elif kind < 0.25 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
        elif kind < 0.35:
            words.insert(3, f"me.{i}@mail.example.org")
        text = " ".join(words)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    return rows


def test_entry_has_every_query():
    names = contract.queries()
    assert set(queries.REGISTRY) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.REGISTRY} == set(range(1, 14))
    assert queries.ORACLE.keys() <= queries.REGISTRY.keys()


def test_stages_take_effect_and_agree_with_plain_computations(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept, rows = docs, corpus()
    by_name = dict(corpus_pipeline.STAGES)

    kept = corpus_pipeline.materialise(by_name["quality classifier"](spark, kept, ""), "test")
    assert kept.columns == COLUMNS
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {r[0] for r in rows if "###" not in r[1]}

    rows = [r for r in rows if r[0] in left]
    kept = corpus_pipeline.materialise(by_name["n-gram Jaccard join"](spark, kept, ""), "test")
    assert kept.columns == COLUMNS
    left = sorted(r["doc_id"] for r in kept.collect())
    assert left == sorted({component for _, _, component in brute([r[:2] for r in rows])})

    rows = [r for r in rows if r[0] in left]
    kept = corpus_pipeline.materialise(by_name["PII"](spark, kept, ""), "test")
    masked = {r["doc_id"]: r for r in kept.collect()}
    for i, text, *_ in rows:
        expected = pii.mask(text, pii.base_spans(text))
        assert masked[i]["text"] == expected and masked[i]["n_chars"] == len(expected)

    plan = {r["doc_id"]: r for r in mixing.mix_sources(kept).collect()}
    kept = corpus_pipeline.materialise(by_name["mixing sources"](spark, kept, ""), "test")
    times = collections.Counter(r["doc_id"] for r in kept.collect())
    assert times == {i: -(-p["taken"] // p["size"]) for i, p in plan.items() if p["taken"] > 0}

    out = by_name["SentencePiece"](spark, kept, "").collect()
    assert collections.Counter(r["doc_id"] for r in out) == times
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]]["text"].encode()).hexdigest()


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by_source.values()) - total) < 1e-6
    for own in by_source.values():
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mix_targets_stop_at_three_times_a_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = [(i, "w " * 5, "en", "a", 10) for i in range(2)]
    rows += [(10 + i, "w " * (1 + i % 3), "en", "b", 10) for i in range(90)] + [(200, None, "en", "c", 0), (None, "", None, None, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target["a"] == 30 and target["c"] == 0 and target[None] == 0
    assert sum(r["taken"] for r in got if r["source"] == "b") == 160
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "a", 1)] * 3 + [(1, "other words here and there", "en", "a", 1), (None, text, "en", "a", 1)]
    rows += [(2, None, "en", "a", 1), (2, None, "en", "a", 1)]
    got = simjoin.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == [(1, "one two three four five six seven"), (1, "other words here and there"), (2, ""), (2, "")]


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, "")
        assert result.collect() == []


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = TEST_DATA / "sf0.001"
    database = duckdb.connect()
    for path in base.glob("*.parquet"):
        database.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = database.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    got = [tuple(r[n] for n in names) for r in contract.queries()[name](spark, str(base)).collect()]
    assert sorted(got, key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_main_queries_on_driver_tables(spark):
    base = str(TEST_DATA / "sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = [tuple(r) for r in queries.op2_jaccard_components(spark, base).collect()]
    assert sorted(got, key=repr) == brute(list(docs.items()))
    rows = queries.op1_token_segments(spark, base).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(docs)
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    scored = queries.op10_toxicity(spark, base).collect()
    assert {r["doc_id"]: r["held_out"] for r in scored} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
