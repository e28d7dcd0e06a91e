"""Column functions on small literal tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom import functions as fn


def column(spark, values, schema, expression):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [row[0] for row in rows.select(expression).collect()]


def test_short_place_name(spark):
    names = ["A-B, X Metro", "A, X", "A B", "Louisville/J-K, X", "A, B-C", "", None]
    short = column(spark, names, "n string", fn.short_place_name(F.col("n")))
    assert short == ["A", "A", "A B", "Louisville/J", "A", "", None]


def test_split_labels(spark):
    labels = spark.createDataFrame([("40|Trade, x",), ("5|",), (None,)], "v string")
    rows = labels.select(*fn.split_labels(F.col("v"), ["code", "name"])).collect()
    assert [tuple(r) for r in rows] == [("40", "Trade, x"), ("5", ""), (None, None)]


@pytest.mark.parametrize("label", ["40", "40|Trade|more", ""])
def test_split_labels_rejects_other_piece_counts(spark, label):
    labels = spark.createDataFrame([(label,)], "v string")
    with pytest.raises(Exception, match="expected 2 pieces"):
        labels.select(*fn.split_labels(F.col("v"), ["code", "name"])).collect()


def test_code_slices_overlap_and_keep_zeros(spark):
    codes = spark.createDataFrame([("SMU06310800000000001",), (None,), ("SMU",)], "v string")
    layout = [("seas", 3, 3), ("state", 4, 5), ("naics", 13, 18), ("industry", 11, 18)]
    rows = [tuple(r) for r in codes.select(*fn.code_slices(F.col("v"), layout)).collect()]
    assert rows == [("U", "06", "000000", "00000000"), (None,) * 4, ("U", "", "", "")]


def test_safe_double(spark):
    texts = [" 12.5 ", "-3", "1e3", "-", "", "12d", "1.5F", "NaN", "Infinity", "x", None]
    numbers = column(spark, texts, "v string", fn.safe_double(F.col("v")))
    assert numbers == [12.5, -3.0, 1000.0] + [None] * 8


def test_ratio_never_raises_or_gives_nan(spark):
    pairs = [(1.0, 4.0), (1.0, 0.0), (0.0, 0.0), (None, 2.0), (2.0, None)]
    pct = column(spark, pairs, "a double, b double", fn.ratio_pct(F.col("a"), F.col("b")))
    assert pct == [25.0, None, None, None, None]


def test_moe_of_proportion_branches(spark):
    rows = [
        (50.0, 100.0, 5.0, 6.0),  # 25 - 0.25 * 36 = 16
        (50.0, 100.0, 3.0, 8.0),  # 9 - 16 < 0, so 9 + 16 = 25
        (50.0, 100.0, 3.0, 6.0),  # exactly zero
        (50.0, 0.0, 3.0, 6.0),
        (50.0, 100.0, None, 6.0),
        (None, 100.0, 3.0, 6.0),
    ]
    moe = column(
        spark,
        rows,
        "a double, b double, ma double, mb double",
        fn.moe_of_proportion(F.col("a"), F.col("b"), F.col("ma"), F.col("mb")),
    )
    assert moe == [0.04, 0.05, 0.0, None, None, None]


def test_dates(spark):
    parts = [(2022, 1), (2024, 12), (None, 3)]
    first = column(spark, parts, "y int, m int", fn.year_month_to_date(F.col("y"), F.col("m")))
    assert first == [dt.date(2022, 1, 1), dt.date(2024, 12, 1), None]
    periods = [("2023", "M05"), ("2023", "M13"), ("2023", "Q1"), (None, "M01"), ("2023", None)]
    date = column(
        spark, periods, "y string, p string", fn.period_to_date(F.col("y"), F.col("p"))
    )
    assert date == [dt.date(2023, 5, 1), None, None, None, None]


def test_week_start_is_monday(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2024, 1, 8), None]
    weeks = column(spark, days, "d date", fn.week_start(F.col("d")))
    assert weeks == [dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 8), None]


def test_plain_number(spark):
    numbers = [49.0, -3.0, 0.25, 5.7500000000000036, 0.0, None]
    text = column(spark, numbers, "v double", fn.plain_number(F.col("v")))
    assert text == ["49", "-3", "0.25", "5.7500000000000036", "0", None]
