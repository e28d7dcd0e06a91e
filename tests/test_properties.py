"""Properties that hold for any input."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import operators as op
from tallyloom.operators import panel as panel_module

few = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
    derandomize=True,
)
groups = st.one_of(st.none(), st.sampled_from(["hot", "hot", "b", "c"]))
weights = st.integers(0, 50).map(float)


@few
@given(st.lists(st.tuples(groups, weights), min_size=1, max_size=40))
def test_shares_of_a_group_sum_to_100(spark, data):
    table = spark.createDataFrame(data, "k string, v double")
    shares = op.share_of_total(table, ["k"], "v", "pct")
    sums = shares.groupBy("k").agg(F.sum("v").alias("v"), F.sum("pct").alias("pct")).collect()
    assert sum(1 for _ in shares.collect()) == len(data)
    for row in sums:
        assert row["pct"] == (pytest.approx(100) if row["v"] else None)


@few
@given(st.lists(st.tuples(groups, st.one_of(st.none(), st.booleans()), weights), max_size=40))
def test_rates_are_fractions_and_add_up(spark, data):
    table = spark.createDataFrame(data, "k string, yes boolean, w double")
    tallies = op.row_tallies(table, F.col("yes"), F.col("w"))
    for row in op.share_rates(tallies, ["k"], "rate").collect():
        assert row["rate"] is None or 0 <= row["rate"] <= 1
    direct = op.tally(tallies).collect()
    assert direct == op.tally(op.tally(tallies, ["k"])).collect()


cells = st.dictionaries(
    st.tuples(st.sampled_from("abc"), st.integers(0, 25)),
    st.one_of(st.none(), st.integers(-9, 9).map(float)),
    min_size=1,
)


@few
@given(cells, st.integers(1, 5), st.integers(1, 6))
def test_rolling_mean_stays_within_its_window(spark, data, k, block):
    start = dt.date(2024, 1, 1)
    table = spark.createDataFrame(
        [(s, start + dt.timedelta(days=d), v) for (s, d), v in data.items()],
        "s string, d date, v double",
    )
    usual, panel_module._BLOCK = panel_module._BLOCK, block
    try:
        rolled = op.rolling_mean(table, ["s"], "d", "v", k, "m").collect()
    finally:
        panel_module._BLOCK = usual
    assert len(rolled) == len(data)
    axis = sorted({d for _, d in data})
    for s, d, v, mean in rolled:
        at = axis.index((d - start).days)
        window = [data.get((s, x)) for x in axis[max(0, at - k + 1) : at + 1]]
        if len(window) < k or None in window:
            assert mean is None
        else:
            assert min(window) - 1e-9 <= mean <= max(window) + 1e-9


@few
@given(cells)
def test_pivot_and_back(spark, data):
    table = spark.createDataFrame([(s, d, v) for (s, d), v in data.items()], "s string, d int, v double")
    names = list("abc")
    wide = op.pivot_ordered(table, ["d"], "s", "v", names)
    back = wide.unpivot("d", names, "s", "v").filter(F.col("v").isNotNull())
    assert {(r["s"], r["d"]): r["v"] for r in back.collect()} == {
        key: v for key, v in data.items() if v is not None
    }
