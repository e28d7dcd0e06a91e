"""What the physical plans must and must not do, on tables in files."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from tallyloom import operators as op
from tallyloom.plans import employment, estimates, occupancy, telework
from tallyloom.plans import fixed_values as fixed
from tallyloom.sources import schemas
from conftest import TEST_DATA
from tallyloom.workload import views
from tallyloom.workload.queries import REGISTRY


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scans(plan: str, table: str) -> list[str]:
    """The details of every scan of a table."""
    details = re.split(r"\n\n", plan)
    return [d for d in details if re.search(r"\(\d+\) Scan parquet", d) and f"/{table}" in d]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")

    def store(name: str, data: list, schema: str):
        path = str(folder / name)
        spark.createDataFrame(data, schema).write.parquet(path)
        return spark.read.parquet(path)

    return store


@pytest.fixture(scope="module")
def persons(stored):
    return stored("persons", [(2023, 1, 37980, 6500, 1, 2.0)], schemas.PERSONS)


def test_monthly_rates_read_once_and_only_their_columns(persons):
    plan = plan_of(telework.monthly_rates(telework.person_tallies(persons), fixed.METRO_CODES))
    [scan] = scans(plan, "persons")
    assert "Not(EqualTo(TELWRKPAY,0))" in scan
    assert "IND" not in scan.split("ReadSchema")[1]


def test_sector_rates_read_once(persons):
    tallies = telework.person_tallies(telework.with_supersector(persons))
    plan = plan_of(telework.sector_rates(tallies, 37980, "here", "all"))
    [scan] = scans(plan, "persons")
    assert "YEAR" not in scan.split("ReadSchema")[1]
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_office_filter_reaches_the_code_table(persons):
    """A condition on the sector turns the left join into an inner one."""
    office = telework.in_sectors(
        telework.person_tallies(telework.with_supersector(persons)), fixed.OFFICE_SECTORS
    )
    plan = plan_of(telework.monthly_rates(office, fixed.METRO_CODES))
    assert re.search(r"Join type: Inner", plan) and "Join type: LeftOuter" not in plan


def test_series_conditions_reach_the_scan(stored):
    series = stored("series", [("SMU42379800000000001", "2023", "M13", "1", None)], schemas.SERIES)
    [scan] = scans(plan_of(employment.annual_averages(series, "2023", ["37980"])), "series")
    assert "EqualTo(period,M13)" in scan and "EqualTo(year,2023)" in scan


def test_listed_geographies_reach_the_scan(stored):
    table = stored("estimates", [("1", "US", "wfh", 1.0, 1.0, 2.0, 1.0)], schemas.ESTIMATES)
    [scan] = scans(plan_of(estimates.shares(table, ["1", "37980"])), "estimates")
    assert "In(GEOID, [1,37980])" in scan
    assert "moe" not in scan.split("ReadSchema")[1]


def test_compared_weeks_reach_the_scan(stored):
    panel = stored("panel", [(dt.date(2023, 1, 4), "Chicago", 50.0)], schemas.OCCUPANCY)
    names = panel.select(panel["city"].alias("msa_short_name")).selectExpr(
        "'1' AS METFIPS", "1D AS wfh_pct", "'n' AS NAME", "msa_short_name"
    )
    plan = plan_of(occupancy.attendance_and_telework(panel, names, "2023-01-01", "2023-12-31"))
    assert any("GreaterThanOrEqual(data_week,2023-01-01)" in s for s in scans(plan, "panel"))


def test_axis_reads_the_date_only(stored):
    panel = stored("weekly", [(dt.date(2023, 1, 4), "Chicago", 50.0)], schemas.OCCUPANCY)
    plan = plan_of(op.rolling_mean(panel, ["city"], "data_week", "occupancy", 4, "m"))
    schemas_read = [s.split("ReadSchema: ")[1].strip() for s in scans(plan, "weekly")]
    assert "struct<data_week:date>" in schemas_read
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, name):
    from conftest import TEST_DATA

    if not TEST_DATA.is_dir():
        pytest.skip("driver tables are not here")
    plan = plan_of(REGISTRY[name](spark, str(TEST_DATA / "sf0.001")))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert node not in plan
    # A window without a partition would sort the whole table in one task.
    for detail in re.findall(r"windowspecdefinition\([^)]*", plan):
        assert "__block" in detail


SMALL = TEST_DATA / "sf0.001"
needs_tables = pytest.mark.skipif(not SMALL.is_dir(), reason="driver tables are not here")


@needs_tables
@pytest.mark.parametrize(
    "name", ["estimates_stacked", "wfh_share_with_bounds", "row_mean_across_series", "employment_sector_share_wide"]
)
def test_line_items_are_read_once(spark, monkeypatch, name):
    """What is read several times is a small staged table, made from one scan."""
    read, table = [], views.table

    def counted(spark, sf_dir, name):
        read.append(name)
        return table(spark, sf_dir, name)

    monkeypatch.setattr(views, "table", counted)
    result = REGISTRY[name](spark, str(SMALL))
    assert read.count("lineitem") == 1
    assert len(scans(plan_of(result), "lineitem")) == 0


@needs_tables
def test_conditions_on_a_lazy_series_reach_the_aggregate(spark):
    plan = plan_of(REGISTRY["filter_conjunction"](spark, str(SMALL)))
    assert scans(plan, "lineitem") and "series-" not in plan


@needs_tables
def test_compared_weeks_reach_the_scan(spark):
    plan = plan_of(REGISTRY["occupancy_and_telework"](spark, str(SMALL)))
    pushed = [s for s in scans(plan, "lineitem") if "GreaterThanOrEqual(l_shipdate" in s]
    assert len(pushed) == 1 and "LessThan(l_shipdate" in pushed[0]
