"""Shards against what went in: whole rows, equal counts, gapless slots, and a uniform order."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import permutations

import pytest

import __spark_entry__ as contract
from conftest import TEST_DATA
from tallyloom.llm import sharding as sh

ROWS = [(i if i % 11 else None, None if i % 7 == 0 else f"text é {i % 50} " * (i % 5), i, "x") for i in range(600)]
HOT = [(77, "the same text " * 20, -1, "x")] * 300
SCHEMA = "doc_id long, text string, bucket int, __key string"


def rows_of(read):
    return sorted(((r.shard, r.slot, *r.record) for r in read.collect()))


def check_law(found, n_rows, n_shards):
    counts = Counter(shard for shard, *_ in found)
    even, more = divmod(n_rows, n_shards)
    assert [counts[s] for s in range(n_shards)] == [even + (s < more) for s in range(n_shards)]
    for s in range(n_shards):
        assert sorted(slot for shard, slot, *_ in found if shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 4_000, 300])
def test_shards_hold_whole_rows(spark, bucket_bytes):
    docs = spark.createDataFrame(ROWS + HOT, SCHEMA)
    shards = sh.write_shards(docs, 7, bucket_bytes=bucket_bytes)
    found = rows_of(sh.read_shards(spark, shards))
    assert sorted((r[2:] for r in found), key=repr) == sorted(ROWS + HOT, key=repr)
    check_law(found, 900, 7)
    one = rows_of(sh.read_shards(spark, shards, 3))
    assert one == [r for r in found if r[0] == 3]
    assert rows_of(sh.read_shards(spark, sh.write_shards(docs, 7, bucket_bytes=bucket_bytes))) == found
    other = rows_of(sh.read_shards(spark, sh.write_shards(docs, 7, seed=8, bucket_bytes=bucket_bytes)))
    assert other != found and sorted(r[2:] for r in other if r[2]) == sorted(r[2:] for r in found if r[2])


def test_the_order_is_that_of_the_rows_not_of_their_partitions(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, "x") for i in range(500)], SCHEMA)
    results = [
        rows_of(sh.read_shards(spark, sh.write_shards(docs.repartition(n), 3, bucket_bytes=2_000)))
        for n in (1, 5)
    ]
    assert results[0] == results[1]


def test_equal_rows_are_spread_over_buckets(spark):
    docs = spark.createDataFrame(HOT * 10 + ROWS, SCHEMA).repartition(4)
    shards = sh.write_shards(docs, 2, bucket_bytes=20_000)
    records = spark.read.parquet(f"{shards.path}/records")
    sizes = [r["count"] for r in records.groupBy("bucket").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 3 * 3_600 / len(sizes)


def test_empty_tables_few_rows_and_wrong_numbers(spark):
    docs = spark.createDataFrame(ROWS[:2], SCHEMA)
    found = rows_of(sh.read_shards(spark, sh.write_shards(docs, 5)))
    check_law(found, 2, 5)
    empty = sh.write_shards(docs.limit(0), 5)
    assert rows_of(sh.read_shards(spark, empty)) == rows_of(sh.read_shards(spark, empty, 4)) == []
    with pytest.raises(ValueError):
        sh.write_shards(docs, 0)
    with pytest.raises(ValueError):
        sh.read_shards(spark, empty, 5)


def test_a_shard_is_read_from_its_own_buckets(spark):
    docs = spark.createDataFrame([(i, "word " * 50, i, "x") for i in range(2_000)], SCHEMA)
    shards = sh.write_shards(docs, 10, bucket_bytes=10_000)
    plan = sh.read_shards(spark, shards, 4)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(bucket), GreaterThanOrEqual(bucket" in plan


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sh.fisher_yates(4, (7, i)).tolist()) for i in range(12_000))
    assert set(seen) == set(permutations(range(4)))
    assert all(abs(n - 500) < 120 for n in seen.values())
    assert sh.fisher_yates(0, (1,)).tolist() == [] and sh.fisher_yates(1, (1,)).tolist() == [0]


@pytest.mark.skipif(not TEST_DATA.is_dir(), reason="driver tables are not here")
def test_query_holds_every_document(spark):
    folder = TEST_DATA / "sf0.001"
    got = contract.queries()["op13_shards"](spark, str(folder)).collect()
    docs = spark.read.parquet(str(folder / "documents.parquet")).collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_law([(r.shard, r.slot) for r in got], len(docs), 40)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    # Places say nothing about ids: shuffled order and id order are all but uncorrelated.
    ranks = {d: i for i, d in enumerate(sorted(r.doc_id for r in got))}
    order = [ranks[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    n, mean = len(order), (len(order) - 1) / 2
    corr = sum((i - mean) * (v - mean) for i, v in enumerate(order)) / sum((i - mean) ** 2 for i in range(n))
    assert abs(corr) < 4 / n**0.5
