"""Positions over all rows against a plain sort, for any number of blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op
from tallyloom.operators import positions

ROWS = [(i, (i * 7919) % 101 if i % 5 else None, "x") for i in range(2_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, value long, position string")


@pytest.mark.parametrize("blocks", [1, 7, 50])
def test_positions_are_those_of_a_sort(spark, blocks):
    placed = op.with_positions(frame(spark), [F.desc_nulls_last("value"), "id"], "place", blocks)
    want = sorted(ROWS, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r["id"]: r["place"] for r in placed.collect()}
    assert got == {row[0]: i + 1 for i, row in enumerate(want)}
    assert placed.columns == ["id", "value", "position", "place"]


def test_clashing_names_are_kept(spark):
    names = ["__block", "__row", "__part", "__record", "__number", "__n"]
    df = spark.createDataFrame([tuple(range(i, i + 6)) for i in range(9)], ", ".join(f"{n} long" for n in names))
    got = op.with_positions(df, [F.desc("__row")]).collect()
    assert sorted(tuple(r) for r in got) == [(*range(i, i + 6), 9 - i) for i in range(9)]


def test_a_column_of_that_name_is_replaced(spark):
    placed = op.with_positions(frame(spark), ["id"])
    assert placed.columns == ["id", "value", "position"]
    assert all(r.position == r.id + 1 for r in placed.collect())


def test_numbers_of_sorted_rows_show_a_reversed_sort(spark):
    up = op.number_rows(frame(spark).orderBy("id")).select("id", "position").collect()
    down = op.number_rows(frame(spark).orderBy(F.desc("id"))).select("id", "position").collect()
    assert {(r.id, r.position) for r in up} == {(i, i + 1) for i in range(2_000)}
    assert {(r.id, r.position) for r in down} == {(i, 2_000 - i) for i in range(2_000)}


def test_a_hot_key_is_spread_over_blocks(spark):
    rows = frame(spark, [(i, 5 if i < 8_000 else i, None) for i in range(10_000)])
    blocks = op.sorted_blocks(rows, ["value"], 10)
    sizes = [r["count"] for r in blocks.groupBy("__block").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 1_000
    places = [r.p for r in op.with_positions(rows, ["value"], "p", 10).select("p").collect()]
    assert sorted(places) == list(range(1, 10_001))


def test_empty_and_single(spark):
    assert op.with_positions(frame(spark, []), ["id"]).collect() == []
    assert op.number_rows(frame(spark, [])).collect() == []
    assert [r.position for r in op.with_positions(frame(spark, ROWS[:1]), ["id"]).collect()] == [1]


def test_carries_cross_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(positions, "_SUPER", 4)
    totals = spark.range(50).select(F.col("id").alias("b"), (F.col("id") * 3 + 1).alias("n"))
    got = {r.b: r.before for r in op.block_carries(totals, "b", {"before": "n"}).collect()}
    assert got == {b: sum(3 * i + 1 for i in range(b)) for b in range(50)}
