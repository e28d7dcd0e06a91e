"""Trailing means over long windows against adding up each window by itself."""

from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op
from tallyloom.operators import long_windows

SCHEMA = "s string, at long, x double, __block string"


def brute(rows, k):
    cells = {(s, at): x for s, at, x, _ in rows}
    out = {}
    for s, at, *_ in rows:
        window = [cells.get((s, p)) for p in range(at - k + 1, at + 1)]
        whole = None if None in window else float(sum(map(Fraction, window))) / k
        out[s, at] = whole
    return out


def panel(seed, n=1_500):
    rng = random.Random(seed)
    rows = []
    # One series holds most rows; gaps, missing values, a missing key and negative positions.
    for s, length in (("hot", n), ("b", 40), (None, 60), ("", 5)):
        start = rng.randrange(-100, 100)
        for at in range(start, start + length):
            if rng.random() < 0.01:
                continue
            x = None if rng.random() < 0.01 else rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9)
            rows.append((s, at, x, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 2, 17, 60, 5_000])
def test_equal_to_brute_force(spark, k):
    rows = panel(k)
    found = op.trailing_mean(spark.createDataFrame(rows, SCHEMA), ["s"], "at", "x", k, "mean")
    assert found.columns == ["s", "at", "x", "__block", "mean"]
    got = {(r.s, r.at): r.mean for r in found.collect()}
    assert got == brute(rows, k)
    assert k > 60 or any(v is not None for v in got.values())


def test_a_window_of_a_hundred_thousand(spark, monkeypatch):
    monkeypatch.setattr(long_windows, "BLOCK_ROWS", 20_000)
    n, k = 300_000, 100_000
    rows = spark.range(n).select(
        F.lit("a").alias("s"), F.col("id").alias("at"), ((F.col("id") * 7919) % 1_000 / 7.0).alias("x")
    )
    found = op.trailing_mean(rows.repartition(3), ["s"], "at", "x", k, "mean")
    got = {r.at: r.mean for r in found.filter(F.col("at") % 24_989 == 0).select("at", "mean").collect()}
    x = [(i * 7919) % 1_000 / 7.0 for i in range(n)]
    for at, mean in got.items():
        assert mean == (float(sum(map(Fraction, x[at - k + 1 : at + 1]))) / k if at >= k - 1 else None)
    assert found.filter(F.col("mean").isNotNull()).count() == n - k + 1
    # Nothing copies rows: the only rows that are unfolded are the carries, one for each block.
    plan = found._jdf.queryExecution().toString()
    assert "Generate explode" not in plan


def test_partitions_do_not_show(spark):
    rows = panel(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    one, seven = (
        sorted((r.s or "-", r.at, r.m) for r in op.trailing_mean(frame.repartition(n), ["s"], "at", "x", 9, "m").filter("m is not null").collect())
        for n in (1, 7)
    )
    assert one == seven


def test_same_as_the_rolling_mean_over_dates(spark):
    rng = random.Random(4)
    day = dt.date(2024, 2, 20)
    rows = [(s, day + dt.timedelta(days=7 * i), float(rng.randrange(50))) for s in "ab" for i in range(30) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, "s string, d date, x double")
    got = {(r.s, r.d): r.m for r in op.exact_rolling_mean(frame, ["s"], "d", "x", 4, "m").collect()}
    want = {(r.s, r.d): r.m for r in op.rolling_mean(frame, ["s"], "d", "x", 4, "m").collect()}
    assert got == want and any(v is not None for v in got.values())


@pytest.mark.parametrize("extra", [("hot", None, 1.0, "x"), ("twice", 5, 1.0, "x")])
def test_bad_rows_fail(spark, extra):
    rows = [("twice", i, 1.0, "x") for i in range(50)] + [extra]
    with pytest.raises(Exception, match="more than one row|a row without"):
        op.trailing_mean(spark.createDataFrame(rows, SCHEMA), ["s"], "at", "x", 3, "m").collect()


def test_empty_replaced_and_wrong(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.trailing_mean(empty, ["s"], "at", "x", 3, "m").collect() == []
    one = spark.createDataFrame([("a", 1, 2.0, "x")], SCHEMA)
    assert op.trailing_mean(one, ["s"], "at", "x", 1, "x").collect()[0].x == 2.0
    with pytest.raises(ValueError):
        op.trailing_mean(one, ["s"], "at", "x", 0, "m")
