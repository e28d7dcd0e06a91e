"""Every report table from the staged inputs, in one job.

    python -m tallyloom.plans.publish --out FOLDER --panel FILE ...

runs it on staged files: CSV for the panel and the estimates, tab-separated text for the
series and the supersector lookup, and CSV, Parquet or fixed-width text for the person microdata. Microdata
that lies in folders by year and month goes through a cube store instead: only new and changed months are read.
Estimates come joined (numerator and denominator in one row) or as pulled, a row per variable.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import join_lookup, ordered_values
from ..session import materialise
from ..sources import read_fixed_width, read_trimmed_tsv, read_typed_csv, schemas, write_report
from . import cube_store, employment, estimates, occupancy, telework
from . import fixed_values as fixed


def publish(
    folder: str,
    panel: DataFrame,
    metro_estimates: DataFrame,
    nation_estimates: DataFrame,
    county_estimates: DataFrame,
    persons: DataFrame | None,
    series: DataFrame,
    supersectors: DataFrame,
    year: str = "2023",
    cube: DataFrame | None = None,
) -> None:
    """Write the report tables below ``folder``, a directory of CSV files each.

    Every input is read once: the cube, the annual averages, the panel and the stacked estimates
    go to the shared folder, and the tables built on them read those. With ``cube``, tallies by
    year, month, area and supersector, ``persons`` are not read.
    """
    geographies = [*fixed.METRO_CODES, fixed.NATION_ID]

    def write(table: DataFrame, name: str) -> None:
        write_report(table, f"{folder}/{name}")

    stacked = materialise(
        estimates.stacked_estimates(metro_estimates, nation_estimates), "estimates"
    )
    panel = materialise(panel, "panel")
    write(stacked, "estimates")
    shares = materialise(estimates.shares_with_bounds(stacked, geographies), "shares")
    names = estimates.area_names(shares)
    write(estimates.by_share(shares), "wfh_share_by_metro")
    write(
        estimates.by_share(estimates.shares(county_estimates, fixed.FOCUS_COUNTIES)),
        "wfh_share_by_county",
    )

    if cube is None:
        cube = materialise(telework.telework_cube(persons), "telework-cube")
    office = telework.in_sectors(cube, fixed.OFFICE_SECTORS)
    for label, tallies in (("all", cube), ("office", office)):
        monthly = materialise(
            telework.monthly_rates(tallies, fixed.METRO_CODES), f"monthly-{label}"
        )
        write(telework.by_month(monthly), f"telework_by_month_{label}_long")
        wide = telework.monthly_rates_wide(monthly, names)
        write(wide.orderBy("date"), f"telework_by_month_{label}_wide")
    write(
        telework.by_total_rate(
            telework.sector_rates(
                cube, fixed.FOCUS_METRO, fixed.FOCUS_PREFIX, fixed.NATION_PREFIX
            ),
            fixed.NATION_PREFIX,
        ),
        "telework_by_sector",
    )
    office_rates = materialise(
        telework.area_rates(office, fixed.METRO_CODES, names), "office-rates"
    )
    write(telework.by_rate(office_rates), "telework_of_office_workers")

    averages = materialise(
        employment.annual_averages(series, year, fixed.METRO_CODES), "annual-averages"
    )
    write(averages.orderBy("series_id"), "employment_by_sector")
    compared = employment.sector_shares(
        averages, names, supersectors, fixed.EMPLOYMENT_METROS
    )
    listed = averages.filter(averages["area_code"].isin(fixed.EMPLOYMENT_METROS))
    named = join_lookup(
        listed, names.withColumnRenamed("GEOID", "area_code"), "area_code"
    )
    columns = ordered_values(named, "msa_short_name", ["series_id"])
    write(
        employment.sector_shares_wide(compared, columns, fixed.FOCUS_CITY),
        "employment_share_by_sector",
    )

    cities = ordered_values(panel, "city", ["city"])
    write(
        occupancy.newest_first(occupancy.weekly_means_wide(panel, cities)), "occupancy_by_week"
    )
    write(
        occupancy.attendance_and_telework(panel, office_rates, *fixed.COMPARED_WEEKS).orderBy(
            "city"
        ),
        "attendance_and_telework",
    )


def _column_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def read_persons(
    spark: SparkSession, path: str, form: str = "parquet", layout: Sequence[tuple] | None = None
) -> DataFrame:
    """Person microdata in a named form: ``csv``, ``parquet``, or ``fixed`` with its layout."""
    if form == "csv":
        return read_typed_csv(spark, path, schemas.PERSONS)
    if form == "parquet":
        return spark.read.schema(schemas.PERSONS).parquet(path)
    if form != "fixed" or layout is None:
        raise ValueError("persons are read as csv, parquet, or fixed with a layout")
    return read_fixed_width(spark, path, layout).select(*_column_names(schemas.PERSONS))


def read_estimates(spark: SparkSession, path: str, pulled: bool = False) -> DataFrame:
    """Survey estimates, or a pull of both variables, whose denominators are then attached."""
    if not pulled:
        return read_typed_csv(spark, path, schemas.ESTIMATES)
    return estimates.working_from_home(read_typed_csv(spark, path, schemas.PULL))


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write every report table.")
    for option in (
        "--out",
        "--panel",
        "--metro-estimates",
        "--nation-estimates",
        "--county-estimates",
        "--persons",
        "--series",
        "--supersectors",
    ):
        parser.add_argument(option, required=True)
    parser.add_argument("--year", default="2023")
    forms = ["csv", "parquet", "fixed", "months"]
    parser.add_argument("--persons-form", choices=forms, default="parquet")
    parser.add_argument("--cube-store", help="folder of the cube, for persons by months")
    parser.add_argument(
        "--persons-layout", type=json.loads, help="JSON list of [name, first, last, type, decimals]"
    )
    parser.add_argument("--pulled", action="store_true", help="estimates have a row per variable")
    given = parser.parse_args(arguments)
    if (given.persons_form == "months") != bool(given.cube_store):
        parser.error("persons by months and a cube store go together")
    spark = SparkSession.builder.appName("tallyloom-publish").getOrCreate()
    persons = cube = None
    if given.cube_store:
        cube_store.refresh_cube(spark, given.persons, given.cube_store)
        cube = cube_store.read_cube(spark, given.cube_store)
    else:
        persons = read_persons(spark, given.persons, given.persons_form, given.persons_layout)
    publish(
        given.out,
        read_typed_csv(spark, given.panel, schemas.OCCUPANCY),
        read_estimates(spark, given.metro_estimates, given.pulled),
        read_estimates(spark, given.nation_estimates, given.pulled),
        read_estimates(spark, given.county_estimates, given.pulled),
        persons,
        read_trimmed_tsv(spark, given.series, _column_names(schemas.SERIES)),
        read_trimmed_tsv(spark, given.supersectors, _column_names(schemas.SUPERSECTORS)),
        given.year,
        cube,
    )


if __name__ == "__main__":
    main()
