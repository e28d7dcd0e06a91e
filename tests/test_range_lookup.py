"""Range lookups from a table against searching sorted bounds."""

from __future__ import annotations

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op

RANGES = "low long, high long, label string"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("low, high", [(0, 0), (-5, 5), (1, 1_000_003), (-(2**60), 2**60), (7, 8), (-9, -2), (2**40 - 1, 2**40)])
def test_intervals_make_up_the_range(spark, low, high):
    df = spark.createDataFrame([(low, high)], "low long, high long")
    found = df.select(F.explode(op.dyadic_intervals("low", "high")).alias("i")).select("i.*").collect()
    parts = sorted((r.node << r.level, (r.node + 1 << r.level) - 1) for r in found)
    assert parts[0][0] == low and parts[-1][1] == high
    assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    assert len(parts) <= 2 * max(1, (high - low + 1).bit_length())
    assert all(sum(r.level == level for r in found) <= 2 for level in range(64))


def test_against_a_search(spark):
    rng = random.Random(6)
    cuts = sorted({rng.randrange(-(2**45), 2**45) for _ in range(200)} | set(range(-60, 60, 3)))
    ranges = [(a, b - 1 - rng.randrange(2), f"r{i % 9}") for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i % 5 and b - a > 1]
    codes = [None, 0, *cuts, *(rng.randrange(-(2**46), 2**46) for _ in range(500)), *[7] * 400]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code long, low int")
    table = spark.createDataFrame(ranges, RANGES)
    got = {r.low: (r.code, r.label) for r in op.lookup_ranges(df, "code", table).collect()}
    for i, code in enumerate(codes):
        at = bisect.bisect_right([r[0] for r in ranges], code) - 1 if code is not None else -1
        want = ranges[at][2] if at >= 0 and code <= ranges[at][1] else None
        assert got[i] == (code, want)


def test_a_million_ranges_from_a_file(spark, tmp_path):
    n = 1_000_000
    table = spark.range(n).select(
        (F.col("id") * 100).alias("low"),
        (F.col("id") * 100 + F.abs(F.hash("id")) % 100).alias("high"),
        F.concat(F.lit("r"), F.col("id") % 1_000).alias("label"),
    )
    wide = spark.createDataFrame([(-(2**31), -1, "wide")], RANGES)
    table.unionByName(wide).write.parquet(str(tmp_path / "ranges"))
    ranges = spark.read.parquet(str(tmp_path / "ranges"))
    # A third of all rows has one code.
    code = F.when(F.col("id") % 3 == 0, 4_211).otherwise((F.hash("id").cast("long") * 31) % (n * 120))
    df = spark.range(60_000).select("id", code.alias("code"))
    found = op.lookup_ranges(df, "code", ranges)
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text
    rows = found.toPandas()
    high = table.select("high").toPandas()["high"].to_numpy()
    at = np.clip(rows["code"] // 100, 0, n - 1)
    inside = (rows["code"] >= 0) & (rows["code"] < n * 100) & (rows["code"] <= high[at])
    want = np.where(inside, "r" + (at % 1_000).astype(str), None)
    want = np.where((rows["code"] < 0) & (rows["code"] >= -(2**31)), "wide", want)
    assert (rows["label"].fillna("-").to_numpy() == np.where(want == None, "-", want)).all()  # noqa: E711
    assert len(rows) == 60_000 and (rows["label"] == "wide").sum() > 100


def test_several_columns_and_no_ranges(spark):
    df = spark.createDataFrame([(5,), (None,)], "code int")
    table = spark.createDataFrame([(0, 9, "a", None), (10, 10, "b", 2.0)], "low int, high int, label string, x double")
    got = op.lookup_ranges(df, "code", table)
    assert got.columns == ["code", "label", "x"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(5, "a", None), (None, None, None)]
    assert [r.label for r in op.lookup_ranges(df, "code", table.limit(0)).collect()] == [None, None]
    assert op.lookup_ranges(df.limit(0), "code", table).collect() == []


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(0, 9, "a"), (9, 12, "b")], "overlaps"),
        ([(0, 100, "a"), (5, 6, "b"), (50, 60, "c")], "overlaps"),
        ([(3, 3, "a"), (3, 3, "a")], "overlaps"),
        ([(5, 4, "a")], "empty range"),
        ([(None, 4, "a")], "without low or high"),
        ([(0, 2**61, "a")], "out of range"),
    ],
)
def test_bad_ranges_fail(spark, rows, message):
    df = spark.createDataFrame([(5,)], "code long")
    with pytest.raises(Exception, match=message):
        op.lookup_ranges(df, "code", spark.createDataFrame(rows, RANGES)).collect()


def test_overlaps_across_blocks(spark):
    rows = [(i * 10, i * 10 + 9, "x") for i in range(3_000)]
    df = spark.createDataFrame([(5,)], "code long")
    assert op.lookup_ranges(df, "code", spark.createDataFrame(rows, RANGES)).first().label == "x"
    for extra in ((14_999, 14_999, "y"), (-1, 30_000, "y")):
        with pytest.raises(ValueError, match="overlaps"):
            op.lookup_ranges(df, "code", spark.createDataFrame([*rows, extra], RANGES))


def test_clashing_names_fail(spark):
    df = spark.createDataFrame([(5, "x")], "code long, label string")
    with pytest.raises(ValueError, match="label"):
        op.lookup_ranges(df, "code", spark.createDataFrame([(0, 9, "a")], RANGES))
