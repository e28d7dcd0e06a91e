"""The published result tables, from published inputs where they exist.

Where an input was never published, one that must give the published result is built from
the result itself, with noise that the rules say must not count.
"""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import assert_table, header, read_rows
from tallyloom.operators import join_lookup, ordered_values
from tallyloom.plans import employment, estimates, occupancy, telework
from tallyloom.plans import fixed_values as fixed
from tallyloom.sources import read_typed_csv, schemas
from tallyloom.workload import views

GEOGRAPHIES = [*fixed.METRO_CODES, fixed.NATION_ID]
SHARE_COLUMNS = ["GEOID", "NAME", "msa_short_name", "wfh_prop", "wfh_90_low", "wfh_90_high"]
ESTIMATE_COLUMNS = [
    "GEOID",
    "NAME",
    "variable",
    "estimate",
    "moe",
    "summary_est",
    "summary_moe",
]
SERIES_COLUMNS = [
    "series_id",
    "year",
    "period",
    "value",
    "footnote_codes",
    "seas_adj",
    "state_code",
    "area_code",
    "supersector_code",
    "naics_code",
    "industry_code",
    "measure_code",
    "date",
]
METROS = [
    "Austin",
    "Chicago",
    "Dallas",
    "Houston",
    "Los Angeles",
    "New York",
    "Philadelphia",
    "San Francisco",
    "San Jose",
    "Washington",
]
UNLISTED = 99999


@pytest.fixture(scope="module")
def names(spark, published):
    [path] = published(*SHARE_COLUMNS)
    shares = read_typed_csv(
        spark,
        str(path),
        "GEOID STRING, NAME STRING, msa_short_name STRING, "
        "wfh_prop DOUBLE, wfh_90_low DOUBLE, wfh_90_high DOUBLE",
    )
    return estimates.area_names(shares)


def test_shares_with_bounds(spark, published):
    [source] = published(*ESTIMATE_COLUMNS)
    [result] = published(*SHARE_COLUMNS)
    table = read_typed_csv(spark, str(source), schemas.ESTIMATES)
    shares = estimates.by_share(estimates.shares_with_bounds(table, GEOGRAPHIES))
    assert_table(shares, read_rows(result), SHARE_COLUMNS)


def test_estimates_are_read_as_published(spark, published):
    [source] = published(*ESTIMATE_COLUMNS)
    table = read_typed_csv(spark, str(source), schemas.ESTIMATES)
    assert_table(table, read_rows(source), ESTIMATE_COLUMNS)


def monthly_files(published):
    """All workers and office workers; the latter telework more."""

    def level(path):
        return sum(float(row["wfh_pct"]) for row in read_rows(path))

    everyone, office = sorted(published("YEAR", "MONTH", "METFIPS", "wfh_pct"), key=level)
    return everyone, office


def test_monthly_rates_wide(spark, published, names):
    source, _ = monthly_files(published)
    [result] = published("date", *METROS, "United States")
    long = read_typed_csv(spark, str(source), schemas.MONTHLY_RATES)
    wide = telework.monthly_rates_wide(long, names).orderBy("date")
    assert_table(wide, read_rows(result), header(result))


def two_answers(p: float, weight: float):
    """A yes and a no whose weighted share is ``p``; any answer but 1 is a no."""
    return [(1, p * weight), (2, (1 - p) * weight)]


def balance(total: float, listed: list[float], rest: float = 1000.0):
    """Answers outside the listed areas that make the overall share ``total``."""
    yes = total * (len(listed) + rest) - sum(listed)
    return [(1, yes), (99, rest - yes)]


NOISE = [(0, 5e6), (None, 7e6)]  # out of the universe, and no answer


def monthly_persons(rows: list[dict], industry: int, noise_industry: int | None):
    months: dict = {}
    for row in rows:
        key = int(row["YEAR"]), int(row["MONTH"])
        months.setdefault(key, {})[row["METFIPS"]] = float(row["wfh_pct"])
    people = []
    for (year, month), rates in months.items():
        total = rates.pop(fixed.NATION_ID)
        for metro, p in rates.items():
            for answer, weight in [*two_answers(p, 1.0), *NOISE]:
                people.append((year, month, int(metro), industry, answer, weight))
        for answer, weight in [*balance(total, list(rates.values())), *NOISE]:
            people.append((year, month, UNLISTED, industry, answer, weight))
        if noise_industry is not None:
            people.append((year, month, int(metro), noise_industry, 1, 3e4))
    return people


def test_monthly_rates_from_persons(spark, published, names):
    source, _ = monthly_files(published)
    rows = read_rows(source)
    people = spark.createDataFrame(monthly_persons(rows, 1070, None), schemas.PERSONS)
    rates = telework.monthly_rates(telework.person_tallies(people), fixed.METRO_CODES)
    assert_table(telework.by_month(rates), rows, ["YEAR", "MONTH", "METFIPS", "wfh_pct"])
    [result] = published("date", *METROS, "United States")
    wide = telework.monthly_rates_wide(rates, names).orderBy("date")
    assert_table(wide, read_rows(result), header(result))


def test_monthly_office_rates_from_cube(spark, published):
    _, source = monthly_files(published)
    rows = read_rows(source)
    people = spark.createDataFrame(monthly_persons(rows, 6470, 6450), schemas.PERSONS)
    office = telework.in_sectors(telework.telework_cube(people), fixed.OFFICE_SECTORS)
    rates = telework.monthly_rates(office, fixed.METRO_CODES)
    assert_table(telework.by_month(rates), rows, ["YEAR", "MONTH", "METFIPS", "wfh_pct"])


def test_sector_rates(spark, published):
    columns = ["supersector_code", "supersector_name", "philly_wfh_pct", "us_wfh_pct"]
    [result] = published(*columns)
    rows = read_rows(result)
    first_code = {label: low for low, _, label in reversed(fixed.SUPERSECTOR_RANGES)}
    metro = int(fixed.FOCUS_METRO)
    people = [(2023, 1, metro, 0, 1, 10.0), (2023, 1, metro, 5, 1, 10.0)]  # unknown, no sector
    people += [(2023, 1, UNLISTED, 0, 2, 10.0)]
    for row in rows:
        industry = first_code[row["supersector_code"]]
        here, total = float(row["philly_wfh_pct"]) / 100, float(row["us_wfh_pct"]) / 100
        for answer, weight in [*two_answers(here, 1.0), *NOISE]:
            people.append((2023, 1, metro, industry, answer, weight))
        for answer, weight in balance(total, [here]):
            people.append((2023, 2, UNLISTED, industry, answer, weight))
    tallies = telework.telework_cube(spark.createDataFrame(people, schemas.PERSONS))
    rates = telework.by_total_rate(
        telework.sector_rates(tallies, metro, "philly", "us"), "us"
    )
    by_rate = sorted(rows, key=lambda r: -float(r["us_wfh_pct"]))
    assert_table(rates, by_rate, columns)


def office_people(rows):
    rates = {r["METFIPS"]: float(r["wfh_pct"]) / 100 for r in rows}
    total = rates.pop(fixed.NATION_ID)
    people = [(2023, 3, int(next(iter(rates))), 1070, 1, 1e4)]  # not an office sector
    for metro, p in rates.items():
        for answer, weight in [*two_answers(p, 1.0), *NOISE]:
            people.append((2023, 3, int(metro), 7000, answer, weight))
    for answer, weight in balance(total, list(rates.values())):
        people.append((2024, 3, UNLISTED, 7790, answer, weight))
    return people


def office_rates(spark, published, names):
    columns = ["METFIPS", "wfh_pct", "NAME", "msa_short_name"]
    [result] = published(*columns)
    rows = read_rows(result)
    people = spark.createDataFrame(office_people(rows), schemas.PERSONS)
    tallies = telework.in_sectors(
        telework.person_tallies(telework.with_supersector(people)), fixed.OFFICE_SECTORS
    )
    return telework.area_rates(tallies, fixed.METRO_CODES, names), rows, columns


def test_office_rates_by_area(spark, published, names):
    rates, rows, columns = office_rates(spark, published, names)
    assert_table(telework.by_rate(rates), rows, columns)


def test_series_identifier(spark, published):
    [source] = published(*SERIES_COLUMNS)
    rows = read_rows(source)
    raw = [(r["series_id"], r["year"], r["period"], f"   {r['value']}", None) for r in rows]
    noise = [
        ("SMS06310800000000001", "2023", "M13", "1", None),  # seasonally adjusted
        ("SMU06310800000000003", "2023", "M13", "1", None),  # another measure
        ("SMU06310801023600001", "2023", "M13", "1", None),  # an industry below a sector
        ("SMU06999990000000001", "2023", "M13", "1", None),  # another area
        ("SMU06310800000000001", "2023", "M05", "1", None),  # a month
        ("SMU06310800000000001", "2022", "M13", "1", None),  # another year
    ]
    series = spark.createDataFrame(raw + noise, schemas.SERIES)
    averages = employment.annual_averages(series, "2023", fixed.METRO_CODES)
    assert_table(
        averages, rows, SERIES_COLUMNS, ordered=False, key=lambda row: row["series_id"]
    )


def test_sector_shares(spark, published, names):
    [source] = published(*SERIES_COLUMNS)
    [result] = published("supersector_name", "Chicago", "New York", "Philadelphia", "Dallas")
    averages = read_typed_csv(spark, str(source), schemas.PARSED_SERIES)
    lookup = spark.createDataFrame(views.SECTOR_LOOKUP, schemas.SUPERSECTORS)
    shares = employment.sector_shares(averages, names, lookup, fixed.EMPLOYMENT_METROS)
    listed = averages.filter(averages["area_code"].isin(fixed.EMPLOYMENT_METROS))
    named = join_lookup(listed, names.withColumnRenamed("GEOID", "area_code"), "area_code")
    columns = ordered_values(named, "msa_short_name", ["series_id"])
    wide = employment.sector_shares_wide(shares, columns, "Philadelphia")
    assert_table(wide, read_rows(result), header(result))


def weekly_input(rows: list[dict]):
    """Weekly values whose trailing 4-row means are the published ones: the three weeks
    before the first are free, every later value follows from two neighbouring means."""
    rows = sorted(rows, key=lambda r: r["data_week"])
    weeks = [dt.date.fromisoformat(r["data_week"]) for r in rows]
    earlier = [weeks[0] - dt.timedelta(days=7 * i) for i in (3, 2, 1)]
    panel = []
    for city in METROS:
        values = [20.0, 25.0, 15.0]
        for row in rows:
            values.append(4 * float(row[city]) - sum(values[-3:]))
        panel += [(week, city, v) for week, v in zip(earlier + weeks, values)]
    return panel


def test_weekly_means(spark, published):
    [result] = published("data_week", *METROS, fixed.MEAN_OF_METROS)
    rows = read_rows(result)
    panel = spark.createDataFrame(weekly_input(rows), schemas.OCCUPANCY)
    wide = occupancy.weekly_means_wide(panel, ordered_values(panel, "city", ["city"]))
    assert_table(occupancy.newest_first(wide), rows, header(result))

    newest = {c: float(rows[0][c]) for c in rows[0] if c != "data_week"}
    ordered = occupancy.columns_by_latest(wide)
    assert ordered.columns[1:] == sorted(newest, key=newest.get, reverse=True)


def test_attendance_and_telework(spark, published, names):
    [result] = published("city", "Office Occupancy", "METFIPS", "Telework Rate", "NAME")
    rows = read_rows(result)
    rates, _, _ = office_rates(spark, published, names)
    panel = []
    for row in rows:
        mean = float(row["Office Occupancy"])
        panel += [
            (dt.date(2022, 10, 1), row["city"], mean - 5),  # both ends count
            (dt.date(2024, 5, 31), row["city"], mean + 5),
            (dt.date(2022, 9, 30), row["city"], 0.0),
            (dt.date(2024, 6, 1), row["city"], 0.0),
        ]
    table = occupancy.attendance_and_telework(
        spark.createDataFrame(panel, schemas.OCCUPANCY), rates, *fixed.COMPARED_WEEKS
    )
    assert_table(table.orderBy("city"), rows, header(result))


def test_county_shares(spark, published):
    columns = ["GEOID", "NAME", "msa_short_name", "wfh_prop"]
    [result] = published(*columns)
    rows = read_rows(result)
    counties = [
        (r["GEOID"], r["NAME"], "wfh", r["wfh_prop"] and float(r["wfh_prop"]) / 4, 1.0, 25.0, 1.0)
        for r in rows
    ]
    counties.append(("01001", "Elsewhere County, Far", "wfh", 1.0, 1.0, 2.0, 1.0))
    table = estimates.shares(
        spark.createDataFrame(counties, schemas.ESTIMATES), fixed.FOCUS_COUNTIES
    )
    assert_table(estimates.by_share(table), rows, columns)
