"""Exact sums against exact rational arithmetic, and the same bits on any number of partitions."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op
from tallyloom.functions.exact import Grid

GREATEST, LEAST = 1.7976931348623157e308, 5e-324


def bits(x):
    return None if x is None else struct.pack(">d", x)


def true_sum(values):
    try:
        return float(sum(map(Fraction, values), Fraction(0)))
    except OverflowError:
        return math.inf if sum(map(Fraction, values)) > 0 else -math.inf


def groups():
    rng = random.Random(11)
    yield [0.1] * 10
    yield [1e16, 1.0, -1e16]
    yield [0.1, 0.2, 0.3, -0.6]
    yield [0.0, -0.0]
    yield [-2.5]
    yield [1.0, 2.0**-53],
    yield [1.0, 2.0**-53, 2.0**-106]
    yield [1.0 + 2.0**-52, 2.0**-53]
    yield [-1.0, -(2.0**-53)]
    for scale in (1, 40, 300):
        for _ in range(12):
            yield [math.ldexp(rng.uniform(-1, 1), rng.randrange(-scale, scale + 1)) for _ in range(rng.randrange(1, 60))]
    for _ in range(6):
        half = [rng.uniform(-1e6, 1e6) for _ in range(30)]
        yield half + [-x for x in half] + [rng.uniform(-1e-9, 1e-9)]


def flat(values):
    return [x for v in values for x in (v if isinstance(v, list) else [v])]


def test_sums_are_the_nearest_doubles(spark):
    data = [flat(g) if isinstance(g, tuple) else g for g in groups()]
    rows = [(i, x) for i, values in enumerate(data) for x in values]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.total for r in op.exact_sums(df, ["g"], {"total": "x"}).collect()}
    for i, values in enumerate(data):
        assert bits(got[i]) == bits(true_sum(values) + 0.0), (i, values)


@pytest.mark.parametrize(
    "values",
    [
        [LEAST, LEAST, LEAST],
        [LEAST * 7, -LEAST * 9],
        [GREATEST, LEAST, -GREATEST],
        [GREATEST, GREATEST],
        [-GREATEST, -GREATEST, 1.0],
        [GREATEST, 2.0**969, 2.0**900],
        [2.2250738585072014e-308, -LEAST, 1.0, -1.0],
    ],
)
def test_the_ends_of_the_range(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert bits(op.exact_sums(df, [], {"s": "x"}).first().s) == bits(true_sum(values))


def test_missing_and_strange_values(spark):
    rows = [(1, None), (2, None), (2, 3.0), (3, math.nan), (3, 1.0), (4, math.inf), (4, 1.0), (5, math.inf), (5, -math.inf)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.s for r in op.exact_sums(df, ["g"], {"s": "x"}).collect()}
    assert got[1] is None and got[2] == 3.0 and got[4] == math.inf
    assert math.isnan(got[3]) and math.isnan(got[5])
    assert op.exact_sums(df.limit(0), ["g"], {"s": "x"}).collect() == []
    assert op.exact_sums(df.limit(0), [], {"s": "x"}).first().s is None


def test_grid_holds_first_and_last_bit():
    assert Grid.covering(1.0, 1.0) == Grid(-4, 5)
    assert Grid.covering(None, None) == Grid(0, 1)
    full = Grid.covering(LEAST, GREATEST)
    assert full.exponent(0) <= -1074 and full.exponent(full.n - 1) <= 1023 < full.exponent(full.n)


def results(spark, partitions):
    spread = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11)
    noise = F.hash("id") / 3.0 * F.pow(F.lit(10.0), (F.col("id") % 13) - 6)
    rows = spark.range(20_000).select("id", spread.alias("g"), noise.alias("x"), F.abs(noise).alias("w"))
    rows = rows.repartition(partitions, "id").sortWithinPartitions(F.hash(F.col("id") + partitions))
    tallies = op.row_tallies(rows, F.col("id") % 2 == 0, F.col("w"))
    tables = [
        op.exact_sums(rows, ["g"], {"a": "x", "b": "w"}),
        op.exact_share_rates(tallies, ["g"], "rate"),
        op.exact_share_rates(tallies, [], "rate"),
        op.exact_mean_by_group(rows, ["g"], "x", "mean"),
        op.exact_row_mean_across_series(rows.dropDuplicates(["g", "id"]), "g", "id", "x", "mean"),
    ]
    return [
        sorted(tuple(bits(v) if isinstance(v, float) else v for v in r) for r in t.collect())
        for t in tables[:4]
    ]


def test_the_same_bits_on_any_number_of_partitions(spark):
    one = results(spark, 1)
    assert results(spark, 7) == one and results(spark, 200) == one


def test_shares_and_means_follow_the_rules(spark):
    rows = [(1, 0.1, True), (1, 0.2, False), (2, None, True), (3, 0.0, True), (None, 0.3, True), (4, 0.0, None)]
    df = spark.createDataFrame(rows, "g int, w double, yes boolean")
    tallies = op.row_tallies(df, F.col("yes"), F.col("w"))
    got = {r.g: r.rate for r in op.exact_share_rates(tallies, ["g"], "rate").collect()}
    want = {r.g: r.rate for r in op.share_rates(tallies, ["g"], "rate").collect()}
    assert got == want == {1: 0.1 / (0.1 + 0.2), 2: None, 3: None, None: 1.0, 4: None}
    means = {r.g: r.m for r in op.exact_mean_by_group(df, ["g"], "w", "m").collect()}
    assert means[2] is None and means[1] == (0.1 + 0.2) / 2
    panel = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.3)], "s string, d int, x double")
    across = {r.d: r.m for r in op.exact_row_mean_across_series(panel, "s", "d", "x", "m").collect()}
    assert across == {1: (0.1 + 0.2) / 2, 2: None}
