"""Operators on small literal tables, with brute force beside the harder ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import operators as op
from tallyloom.operators import panel as panel_module
from tallyloom.operators import shares as shares_module
from tallyloom.plans import occupancy, telework
from tallyloom.plans import fixed_values as fixed
from tallyloom.sources import schemas

START = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return START + dt.timedelta(days=i)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


# --- recoding and lists ------------------------------------------------------------------

EDGES = [(0, "00"), (169, None), (170, "10"), (490, "10"), (491, None), (570, "40")]
EDGES += [(690, "40"), (769, None), (770, "20"), (771, None), (1070, "30"), (3990, "30")]
EDGES += [(3991, None), (4070, "40"), (5790, "40"), (5791, None), (6070, "40"), (6390, "40")]
EDGES += [(8560, None), (8561, "70"), (9890, "90"), (9891, None), (-1, None), (None, None)]


def test_recode_ranges(spark):
    codes = spark.createDataFrame([(c,) for c, _ in EDGES], "IND int")
    got = dict(rows(op.recode_ranges(codes, "IND", fixed.SUPERSECTOR_RANGES, "code")))
    assert got == dict(EDGES)


def test_long_recode_joins_on_equality(spark):
    ranges = [(i * 10, i * 10 + 4, str(i)) for i in range(100)]
    codes = spark.range(1000).withColumn("c", F.col("id").cast("int"))
    recoded = op.recode_ranges(codes, "c", ranges, "label")
    plan = recoded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert {r["c"]: r["label"] for r in recoded.collect()} == {
        c: str(c // 10) if c % 10 <= 4 else None for c in range(1000)
    }


@pytest.mark.parametrize("ranges", [[(1, 5, "a"), (5, 9, "b")], [(3, 2, "a")]])
def test_recode_rejects_bad_ranges(spark, ranges):
    with pytest.raises(ValueError):
        op.recode_ranges(spark.range(1), "id", ranges, "label")


def test_keep_listed_converts_whole_numbers_and_texts_once(spark):
    df = spark.createDataFrame([(1, "1"), (2, "a'b\\"), (3, None), (None, "x")], "`c``d` bigint, t string")
    assert rows(op.keep_listed(df.withColumnRenamed("c`d", "c"), "c", ["1", 3, 3.0, None]).select("c")) == [(1,), (3,)]
    assert rows(op.keep_listed(df.select("t"), "t", ["a'b\\", 1, None])) == [("1",), ("a'b\\",)]
    small = spark.createDataFrame([(1,), (127,)], "c tinyint")
    assert rows(op.keep_listed(small, "c", [5_000_000_000, 127])) == [(127,)]
    assert rows(op.keep_listed(small, "c", [])) == rows(op.keep_listed(small, "c", [None])) == []


def test_keep_listed(spark):
    codes = spark.createDataFrame([(37980,), (1,), (None,), (37980,)], "c int")
    assert rows(op.keep_listed(codes, "c", ["37980", "12420"])) == [(37980,), (37980,)]


def test_keep_dates_includes_both_days(spark):
    days = [day(0), day(1), day(2), day(3), None]
    table = spark.createDataFrame([(d,) for d in days], "d date")
    kept = [(day(1),), (day(2),)]
    assert rows(op.keep_dates(table, "d", str(day(1)), str(day(2)))) == kept
    hours = table.select((F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")).alias("t"))
    late = op.keep_dates(hours, "t", str(day(1)), str(day(2)))
    assert [r[0].date() for r in rows(late)] == [day(1), day(2)]


def test_missing_answers_are_not_in_the_universe(spark):
    people = [(2023, 1, 1, 1, answer, 1.0) for answer in (0, 1, 2, 99, None)]
    asked = telework.person_tallies(spark.createDataFrame(people, schemas.PERSONS))
    assert sorted(r["TELWRKPAY"] for r in asked.collect()) == [1, 2, 99]


# --- joins -------------------------------------------------------------------------------


def test_join_null_safe(spark):
    keys = "k1 string, k2 string"
    left = spark.createDataFrame([("a", "x", 1), (None, None, 2), ("b", None, 3)], f"{keys}, l int")
    right = spark.createDataFrame(
        [("a", "x", 10), (None, None, 20), ("b", "y", 30)], f"{keys}, r int"
    )
    joined = op.join_null_safe(left, right, ["k1", "k2"])
    assert joined.columns == ["k1", "k2", "l", "r"]
    assert sorted(rows(joined), key=lambda r: r[2]) == [("a", "x", 1, 10), (None, None, 2, 20)]


def test_join_dimension_keeps_left_key(spark):
    left = spark.createDataFrame([("1", 1.0), ("2", 2.0), (None, 3.0)], "METFIPS string, v double")
    names = spark.createDataFrame([("1", "One"), (None, "None")], "GEOID string, NAME string")
    joined = op.join_dimension(left, names, "METFIPS", "GEOID")
    assert joined.columns == ["METFIPS", "v", "NAME"] and rows(joined) == [("1", 1.0, "One")]


def test_attach_denominator(spark):
    pull = [
        ("1", "A", "n", 5.0, 1.0),
        ("1", "A", "d", 10.0, 2.0),
        ("1", "A", "other", 7.0, 7.0),
        ("2", "B", "n", None, None),
        ("2", "B", "d", 20.0, 3.0),
        ("3", "C", "n", 4.0, 1.0),
        ("4", "D", "d", 9.0, 1.0),
    ]
    table = spark.createDataFrame(
        pull, "GEOID string, NAME string, variable string, estimate double, moe double"
    )
    attached = op.attach_denominator(table, {"wfh": "n", "again": "other"}, "d")
    assert attached.columns == schemas_names(schemas.ESTIMATES)
    assert sorted(rows(attached), key=str) == [
        ("1", "A", "again", 7.0, 7.0, 10.0, 2.0),
        ("1", "A", "wfh", 5.0, 1.0, 10.0, 2.0),
        ("2", "B", "wfh", None, None, 20.0, 3.0),
        ("3", "C", "wfh", 4.0, 1.0, None, None),
    ]


def test_attach_denominator_rejects_two_rows(spark):
    for twice in ("n", "d"):
        pull = [("1", "A", "n", 5.0, 1.0), ("1", "A", "d", 9.0, 1.0), ("1", "A", twice, 6.0, 1.0)]
        table = spark.createDataFrame(
            pull, "GEOID string, NAME string, variable string, estimate double, moe double"
        )
        with pytest.raises(Exception, match="more than one row of"):
            op.attach_denominator(table, {"wfh": "n"}, "d").collect()


def schemas_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


# --- shares ------------------------------------------------------------------------------


def tallies(spark, data):
    table = spark.createDataFrame(data, "k string, yes boolean, w double")
    return op.row_tallies(table, F.col("yes"), F.col("w"))


def test_share_rates(spark):
    data = [
        ("a", True, 1.0),
        ("a", False, 3.0),
        (None, True, 2.0),
        ("zero", True, 0.0),
        ("no weight", True, None),
        ("no weight", True, 1.0),
        ("no answer", None, 1.0),
        ("no answer, no weight", None, 0.0),
        ("no answer, no weight", True, 4.0),
    ]
    got = dict(rows(op.share_rates(tallies(spark, data), ["k"], "rate")))
    assert got == {
        "a": 0.25,
        None: 1.0,
        "zero": None,
        "no weight": None,
        "no answer": None,
        "no answer, no weight": 1.0,
    }


def test_total_of_no_rows_is_one_missing_rate(spark):
    nothing = tallies(spark, [("a", True, 1.0)]).filter("false")
    assert rows(op.total_rate(nothing, "area", "1", "rate")) == [("1", None)]
    by_area = op.rates_with_total(nothing, [], "k", ["a"], "1", "rate", keep_missing=True)
    assert rows(by_area) == [("1", None)]


def random_people(seed: int, n: int = 3000):
    """A third of all persons live in one area; some areas and answers are missing."""
    rnd = random.Random(seed)
    people = []
    for _ in range(n):
        area = 7 if rnd.random() < 1 / 3 else rnd.choice([*range(30), None])
        people.append(
            (
                rnd.choice([2022, 2023]),
                rnd.randint(1, 3),
                area,
                rnd.choice([0, 5, 200, 6500, 7000, 7500]),
                rnd.choice([0, 1, 2, 99, None]),
                float(rnd.randint(0, 9)),
            )
        )
    return people


def brute_rate(people):
    total = sum(p[5] for p in people)
    return sum(p[5] for p in people if p[4] == 1) / total if total else None


@pytest.mark.parametrize("from_cube", [False, True])
def test_rates_with_total_against_brute_force(spark, from_cube):
    people = random_people(3)
    table = spark.createDataFrame(people, schemas.PERSONS)
    source = telework.telework_cube(table) if from_cube else telework.person_tallies(table)
    got = {r[:3]: r[3] for r in rows(telework.monthly_rates(source, ["7", "3", "12"]))}
    asked = [p for p in people if p[4] not in (0, None)]
    want = {}
    for year, month in {p[:2] for p in asked}:
        here = [p for p in asked if p[:2] == (year, month)]
        want[year, month, "1"] = brute_rate(here)
        for area in (7, 3, 12):
            want[year, month, str(area)] = brute_rate([p for p in here if p[2] == area])
    assert got == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-12)


def test_sector_rates_against_brute_force(spark):
    people = random_people(5)
    table = spark.createDataFrame(people, schemas.PERSONS)
    got = {r[0]: r[2:] for r in rows(telework.sector_rates(telework.telework_cube(table), 7, "a", "b"))}
    sectors = {200: "10", 6500: "50", 7000: "55", 7500: "60"}
    asked = [p for p in people if p[4] not in (0, None)]
    for code, sector in sectors.items():
        here = [p for p in asked if p[3] == code]
        both = brute_rate([p for p in here if p[2] == 7]), brute_rate(here)
        assert got[sector] == pytest.approx([100 * r for r in both], abs=1e-10)
    assert set(got) == set(sectors.values())


def test_sums_start_before_the_shuffle(spark):
    table = spark.createDataFrame(random_people(1, 50), schemas.PERSONS)
    rates = telework.monthly_rates(telework.person_tallies(table), ["7"])
    plan = rates._jdf.queryExecution().executedPlan().toString()
    first_shuffle = plan.rindex("Exchange")
    assert "partial_sum" in plan[first_shuffle:]
    assert "Expand" not in plan[first_shuffle:], "grouping sets must run over the folded table"


def test_mean_by_group_is_missing_if_any_value_is(spark):
    data = [("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), (None, 4.0)]
    table = spark.createDataFrame(data, "k string, v double")
    assert dict(rows(op.mean_by_group(table, ["k"], "v", "m"))) == {"a": 2.0, "b": None, None: 4.0}


# --- panels ------------------------------------------------------------------------------


def rolled(spark, data, k=4):
    table = spark.createDataFrame(data, "s string, d date, v double")
    out = op.rolling_mean(table, ["s"], "d", "v", k, "m")
    assert out.columns == ["s", "d", "v", "m"]
    return {(r["s"], r["d"]): r["m"] for r in out.collect()}


def test_rolling_mean_is_trailing(spark):
    got = rolled(spark, [("a", day(7 * i), float(i)) for i in range(6)])
    assert [got["a", day(7 * i)] for i in range(6)] == [None, None, None, 1.5, 2.5, 3.5]


def test_rolling_mean_counts_rows_of_all_series_not_days(spark):
    """Series b misses a date of the panel; uneven gaps between dates do not matter."""
    days = [0, 8, 14, 21, 22, 50]
    data = [("a", day(d), float(d)) for d in days] + [("b", day(d), float(d)) for d in days if d != 14]
    got = rolled(spark, data, k=2)
    assert got["a", day(50)] == 36.0 and got["a", day(14)] == 11.0
    assert got["b", day(8)] == 4.0
    assert got["b", day(21)] is None  # the date before it is missing
    assert got["b", day(22)] == 21.5
    assert ("b", day(14)) not in got


def test_rolling_mean_of_missing_value(spark):
    data = [("a", day(i), None if i == 2 else float(i)) for i in range(6)]
    got = rolled(spark, data, k=2)
    assert [got["a", day(i)] for i in range(6)] == [None, 0.5, None, None, 3.5, 4.5]


@pytest.mark.parametrize("seed,block,k", [(1, 4, 4), (2, 3, 5), (3, 1, 3), (4, 4096, 4), (5, 4, 1)])
def test_rolling_mean_against_dense_grid(spark, monkeypatch, seed, block, k):
    """Blocks shorter and longer than the window; one series holds a third of the rows."""
    monkeypatch.setattr(panel_module, "_BLOCK", block)
    rnd = random.Random(seed)
    days = sorted(rnd.sample(range(400), 60))
    data = [("hot", day(d), float(rnd.randint(0, 99))) for d in days]
    for s in "abcd":
        data += [
            (s, day(d), rnd.choice([None, float(rnd.randint(0, 99))]))
            for d in days
            if rnd.random() < 0.6
        ]
    cells = {(s, d): v for s, d, v in data}
    want = {}
    for s, d in cells:
        at = days.index((d - START).days)
        window = [cells.get((s, day(x))) for x in days[max(0, at - k + 1) : at + 1]]
        full = len(window) == k and None not in window
        want[s, d] = sum(window) / k if full else None
    assert rolled(spark, data, k) == pytest.approx(want)


def test_rolling_mean_has_no_cross_join_or_grid(spark):
    table = spark.createDataFrame([("a", day(0), 1.0)], "s string, d date, v double")
    plan = op.rolling_mean(table, ["s"], "d", "v", 4, "m")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rolling_mean_rejects_two_rows_for_a_date(spark):
    with pytest.raises(Exception, match="more than one row"):
        rolled(spark, [("a", day(0), 1.0), ("a", day(1), 2.0), ("a", day(1), 2.0)])


def test_time_axis_needs_dates(spark):
    with pytest.raises(TypeError):
        op.time_axis(spark.range(3), "id")


def test_means_across_series(spark):
    data = [("a", day(0), 1.0), ("b", day(0), 3.0), ("a", day(1), 5.0), ("b", day(1), None)]
    data += [("a", day(2), 7.0)]
    table = spark.createDataFrame(data, "s string, d date, v double")
    want = {day(0): 2.0, day(1): None, day(2): None}
    assert dict(rows(op.row_mean_across_series(table, "s", "d", "v", "m"))) == want
    wide = op.pivot_ordered(table, ["d"], "s", "v", ["a", "b"])
    assert {r["d"]: r["m"] for r in op.row_mean(wide, ["a", "b"], "m").collect()} == want


def test_cut_off_comes_after_smoothing(spark):
    panel = spark.createDataFrame(
        [(day(7 * i), c, float(i)) for i in range(6) for c in ("x", "y")], schemas.OCCUPANCY
    )
    wide = occupancy.weekly_means_wide(panel, ["x", "y"], str(day(21)))
    got = rows(occupancy.newest_first(wide))
    assert [r[0] for r in got] == [day(35), day(28), day(21)]
    assert got[-1][1:] == (1.5, 1.5, 1.5)


def test_columns_by_latest(spark):
    wide = spark.createDataFrame(
        [(day(0), 9.0, 9.0, 9.0, 9.0), (day(7), 1.0, None, 3.0, 1.0)],
        "data_week date, a double, b double, `c d` double, e double",
    )
    assert occupancy.columns_by_latest(wide).columns == ["data_week", "c d", "a", "e", "b"]


def test_latest_values(spark):
    data = [("a", day(0), 1.0), ("a", day(9), 5.0), ("b", day(0), 7.0), ("c", day(9), 6.0)]
    table = spark.createDataFrame(data, "s string, d date, v double")
    latest = op.sort_desc_nulls_last(op.latest_values(table, "s", "d", "v", "v"), "v", "s")
    assert rows(latest) == [("c", 6.0), ("a", 5.0), ("b", None)]


def test_share_of_total(spark):
    data = [("a", 1.0), ("a", 3.0), (None, 2.0), ("z", 0.0), ("m", 1.0), ("m", None)]
    data += [("hot", 1.0)] * 500
    table = spark.createDataFrame(data, "k string, v double")
    shares = op.share_of_total(table, ["k"], "v", "pct")
    assert shares.columns == ["k", "v", "pct"]
    got = sorted(rows(shares), key=str)
    want = [("a", 1.0, 25.0), ("a", 3.0, 75.0), (None, 2.0, 100.0), ("z", 0.0, None)]
    want += [("m", 1.0, None), ("m", None, None)] + [("hot", 1.0, 0.2)] * 500
    assert got == sorted(want, key=str)


def test_share_of_total_sorts_no_group(spark):
    table = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = op.share_of_total(table, ["k"], "v", "pct")._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.fixture
def no_broadcasts(spark):
    """Every side too large to broadcast, and small partitions that count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def hot_rows(spark, n=60_000):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000)
    return spark.range(0, n, numPartitions=8).select(
        "id", key.alias("k"), F.lit(1.0).alias("v"), F.uuid().alias("wide")
    )


def test_hot_group_is_split_when_totals_are_not_broadcast(spark, no_broadcasts):
    shares = op.share_of_total(hot_rows(spark), ["k"], "v", "pct")
    got = {r["k"]: r["pct"] for r in shares.collect()}
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
    assert got[-1] == 100 / 20_000 and len(got) == 1001


def test_hot_key_is_split_when_a_dimension_is_not_broadcast(spark, no_broadcasts):
    names = spark.range(-1, 1000).select(F.col("id").alias("key"), F.lit("x").alias("name"))
    joined = op.join_dimension(hot_rows(spark), names, "k", "key")
    assert len(joined.collect()) == 60_000
    assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()


# --- reshaping ---------------------------------------------------------------------------


def test_pivot_ordered(spark):
    data = [(1, "b", 1.0), (1, "a", 2.0), (2, "a", None), (2, "c d", 4.0)]
    table = spark.createDataFrame(data, "id int, k string, v double")
    wide = op.pivot_ordered(table, ["id"], "k", "v", ["b", "a", "c d"])
    assert wide.columns == ["id", "b", "a", "c d"]
    assert sorted(rows(wide)) == [(1, 1.0, 2.0, None), (2, None, None, 4.0)]


def test_pivot_rejects_two_rows_for_a_cell(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="more than one row for a cell"):
        op.pivot_ordered(table, ["id"], "k", "v", ["a"]).collect()


def test_ordered_values(spark):
    table = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), (None, 0), ("z", 2)], "k string, o int")
    assert op.ordered_values(table, "k", ["o"]) == ["y", "x", "z"]
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="more than 2"):
            op.ordered_values(table, "k", ["o"])
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


@pytest.mark.parametrize("stray", ["z", None])
def test_pivot_rejects_names_outside_the_list(spark, stray):
    table = spark.createDataFrame([(1, "x", 1.0), (2, stray, 2.0)], "id int, k string, v double")
    with pytest.raises(Exception, match="not among the columns"):
        op.pivot_ordered(table, ["id"], "k", "v", ["x"]).collect()


def test_rolling_mean_rejects_dates_off_the_axis(spark):
    table = spark.createDataFrame([("a", day(i), 1.0) for i in range(3)], "s string, d date, v double")
    short = table.filter(F.col("d") != F.lit(day(1)))
    with pytest.raises(Exception, match="not on the axis"):
        op.rolling_mean(table, ["s"], "d", "v", 2, "m", axis=short).collect()
    missing = spark.createDataFrame([("a", day(0), 1.0), ("a", None, 1.0)], "s string, d date, v double")
    with pytest.raises(Exception, match="not on the axis"):
        op.rolling_mean(missing, ["s"], "d", "v", 2, "m").collect()


def test_latest_values_rejects_two_rows_for_a_date(spark):
    table = spark.createDataFrame([("a", day(0), 1.0), ("a", day(0), 9.0)], "s string, d date, v double")
    with pytest.raises(Exception, match="more than one row"):
        op.latest_values(table, "s", "d", "v", "v").collect()


@pytest.mark.parametrize("n", [3, 999, 1_001])
def test_lists_of_any_length_and_mixed_types(spark, n):
    table = spark.range(2_000).select(F.col("id").cast("int"))
    wanted = [i if i % 2 else str(i) for i in range(n)] + ["1", 1]
    kept = op.keep_listed(table, "id", wanted)
    assert sorted(r[0] for r in kept.collect()) == list(range(n))


def test_wide_ranges_cost_no_row_per_code(spark):
    ranges = [(0, 2**31 - 2, "wide"), (-5, -1, "low"), (-2**31, -2**30, "far")]
    table = spark.createDataFrame([(0,), (2**31 - 2,), (2**31 - 1,), (-3,), (-6,), (-2**30,), (None,)], "c int")
    coded = op.recode_ranges(table, "c", ranges, "label")
    got = {r["c"]: r["label"] for r in coded.collect()}
    assert got == {0: "wide", 2**31 - 2: "wide", 2**31 - 1: None, -3: "low", -6: None, -2**30: "far", None: None}
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_narrow_ranges(spark):
    ranges = [(i * 10, i * 10 + i % 9, f"r{i}") for i in range(3_000)]
    coded = op.recode_ranges(spark.range(30_010), "id", ranges, "label")
    got = {r["id"]: r["label"] for r in coded.collect()}
    assert len(got) == 30_010
    for code, label in got.items():
        i = code // 10
        assert label == (f"r{i}" if i < 3_000 and code % 10 <= i % 9 else None)


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    c = spark.createDataFrame([(3,)], "n int")
    assert rows(op.union_by_name(a, b, c)) == [(1, "x"), (2, "y"), (3, None)]


def test_sort_desc_nulls_last(spark):
    data = [("d", None), ("b", 1.0), ("a", 1.0), ("c", None), ("e", 2.0)]
    table = spark.createDataFrame(data, "k string, v double")
    assert [r[0] for r in rows(op.sort_desc_nulls_last(table, "v", "k"))] == list("eabcd")


def test_checks(spark):
    table = spark.createDataFrame([("a|b",), ("a|b",), ("a",), (None,), ("a|b|c",)], "k string")
    assert rows(op.duplicate_keys(table, ["k"])) == [("a|b", 2)]
    wrong = rows(op.wrong_piece_count(table, F.col("k"), 2))
    assert sorted(wrong) == [("a",), ("a|b|c",)]


def test_tallies_add_up(spark):
    """Any grain sums to the same total, unlisted and missing areas included."""
    table = spark.createDataFrame(random_people(9), schemas.PERSONS)
    cube = telework.telework_cube(table)
    whole = op.tally(telework.person_tallies(table)).collect()[0]
    summed = cube.agg(*(F.sum(m).alias(m) for m in shares_module.MEASURES)).collect()[0]
    assert tuple(whole) == tuple(summed)
