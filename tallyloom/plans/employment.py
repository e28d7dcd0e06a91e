"""Employment by supersector from published series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code_slices, period_to_date, safe_double
from ..operators import (
    join_dimension,
    join_lookup,
    keep_listed,
    pivot_ordered,
    share_of_total,
    sort_desc_nulls_last,
)
from . import fixed_values as fixed


def parsed_series(series: DataFrame) -> DataFrame:
    """Series with their identifier cut into codes, a date and a numeric value."""
    return series.select(
        "series_id",
        "year",
        "period",
        safe_double(F.col("value")).alias("value"),
        "footnote_codes",
        *code_slices(F.col("series_id"), fixed.SERIES_LAYOUT),
        period_to_date(F.col("year"), F.col("period")).alias("date"),
    )


def annual_averages(series: DataFrame, year: str, areas: Sequence[str]) -> DataFrame:
    """Unadjusted annual averages of all employees in the listed areas, by supersector.

    The conditions on year and period are on columns of the file and reach the scan.
    """
    parsed = parsed_series(series)
    return keep_listed(parsed, "area_code", areas).filter(
        (F.col("period") == fixed.ANNUAL_AVERAGE)
        & (F.col("year") == year)
        & (F.col("naics_code") == fixed.ALL_INDUSTRIES)
        & (F.col("seas_adj") == fixed.NOT_ADJUSTED)
        & (F.col("measure_code") == fixed.ALL_EMPLOYEES)
    )


def sector_shares(
    averages: DataFrame,
    names: DataFrame,
    supersectors: DataFrame,
    areas: Sequence[str],
    sectors: Sequence[str] = fixed.REPORTED_SUPERSECTORS,
) -> DataFrame:
    """Percent each supersector has of the employment in its area (long).

    The total is over the listed supersectors that the lookup names: the series also hold
    totals of several sectors, which would count jobs twice. ``averages`` is read twice, so
    pass a written table.
    """
    listed = keep_listed(keep_listed(averages, "supersector_code", sectors), "area_code", areas)
    named = join_lookup(
        join_dimension(listed, names, "area_code", "GEOID"), supersectors, "supersector_code"
    )
    return share_of_total(
        named.select("area_code", "msa_short_name", "supersector_name", "value"),
        ["area_code"],
        "value",
        "sector_prop",
    ).select("msa_short_name", "supersector_name", "sector_prop")


def sector_shares_wide(shares: DataFrame, columns: Sequence[str], sort_by: str) -> DataFrame:
    """A row per supersector and a column per area, largest share in ``sort_by`` first."""
    wide = pivot_ordered(shares, ["supersector_name"], "msa_short_name", "sector_prop", columns)
    return sort_desc_nulls_last(wide, sort_by, "supersector_name")
