"""Telework rates from person microdata.

Every function takes *tallies* (see ``operators.shares``): rows of ``person_tallies``, or
any sum of them that still has the columns it groups by, such as ``telework_cube``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import year_month_to_date
from ..operators import (
    join_dimension,
    keep_listed,
    label_codes,
    ordered_values,
    pivot_ordered,
    rates_with_total,
    recode_ranges,
    row_tallies,
    sort_desc_nulls_last,
    tally,
)
from . import fixed_values as fixed
from .estimates import area_order


def with_supersector(persons: DataFrame) -> DataFrame:
    """Add the code of the supersector that the industry code falls in."""
    return recode_ranges(persons, "IND", fixed.SUPERSECTOR_RANGES, "supersector_code")


def person_tallies(
    persons: DataFrame,
    yes_code: int = fixed.TELEWORKED,
    out_of_universe: int = fixed.OUT_OF_UNIVERSE,
) -> DataFrame:
    """Persons asked the question, each as a tally. Any answer but ``yes_code`` is a no."""
    asked = persons.filter(F.col("TELWRKPAY") != out_of_universe)
    return row_tallies(asked, F.col("TELWRKPAY") == yes_code, F.col("WTFINL"))


def telework_cube(persons: DataFrame) -> DataFrame:
    """Tallies by year, month, area and supersector: every rate below is a sum over it.

    Its size is set by the codes, not by the persons. Where several rates are wanted, write
    it once (see ``publish``) so that the microdata is read once.
    """
    return tally(
        person_tallies(with_supersector(persons)),
        ["YEAR", "MONTH", "METFIPS", "supersector_code"],
    )


def in_sectors(tallies: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Tallies of the listed supersectors, such as the office sectors."""
    return keep_listed(tallies, "supersector_code", sectors)


def monthly_rates(
    tallies: DataFrame, areas: Sequence[str], total_id: str = fixed.NATION_ID
) -> DataFrame:
    """Rate by month for the listed areas and for all persons (as a fraction)."""
    return rates_with_total(tallies, ["YEAR", "MONTH"], "METFIPS", areas, total_id, "wfh_pct")


def by_month(rates: DataFrame, total_id: str = fixed.NATION_ID) -> DataFrame:
    """Report order of monthly rates: areas by month, then the total by month."""
    return rates.orderBy(F.col("METFIPS") == total_id, "YEAR", "MONTH", "METFIPS")


def monthly_rates_wide(
    rates: DataFrame, names: DataFrame, total_id: str = fixed.NATION_ID
) -> DataFrame:
    """Percent by month, a column per area in order of area code with the total last."""
    order = area_order(names, total_id)
    columns = ordered_values(order, "msa_short_name", ["is_total", "GEOID"])
    long = join_dimension(rates, names, "METFIPS", "GEOID").select(
        year_month_to_date(F.col("YEAR"), F.col("MONTH")).alias("date"),
        "msa_short_name",
        (F.col("wfh_pct") * 100).alias("wfh_pct"),
    )
    return pivot_ordered(long, ["date"], "msa_short_name", "wfh_pct", columns)


def sector_rates(
    tallies: DataFrame, focus_area: int | str, focus_name: str, total_name: str
) -> DataFrame:
    """Percent by supersector for one area beside all areas.

    Both rates come from one aggregate: the area's sums are conditional sums. Sectors the
    area does not have are left out, and so are the unknown sector and codes of no sector.
    """
    here = F.col("METFIPS") == focus_area
    known = tallies.filter(F.col("supersector_code") != fixed.UNKNOWN_SECTOR)

    def percent(rows: Column) -> Column:
        weight, yes, missing = (
            F.sum(F.when(rows, F.col(m))) for m in ("sum_w", "sum_w_yes", "n_missing")
        )
        return F.when(missing == 0, F.try_divide(yes, weight) * 100)

    focus, total = f"{focus_name}_wfh_pct", f"{total_name}_wfh_pct"
    return (
        known.groupBy("supersector_code")
        .agg(
            percent(here).alias(focus),
            percent(F.lit(True)).alias(total),
            F.count_if(here).alias("__n_here"),
        )
        .filter(F.col("__n_here") > 0)
        .select(
            "supersector_code",
            label_codes(F.col("supersector_code"), fixed.SUPERSECTOR_NAMES).alias(
                "supersector_name"
            ),
            focus,
            total,
        )
    )


def by_total_rate(table: DataFrame, total_name: str) -> DataFrame:
    """Report order of sector rates."""
    return sort_desc_nulls_last(table, f"{total_name}_wfh_pct", "supersector_code")


def area_rates(
    tallies: DataFrame,
    areas: Sequence[str],
    names: DataFrame,
    total_id: str = fixed.NATION_ID,
) -> DataFrame:
    """Percent over the whole period for the listed areas and for all persons, with names."""
    rates = rates_with_total(
        tallies, [], "METFIPS", areas, total_id, "wfh_pct", keep_missing=True
    )
    named = join_dimension(rates, names, "METFIPS", "GEOID")
    return named.withColumn("wfh_pct", F.col("wfh_pct") * 100).select(
        "METFIPS", "wfh_pct", "NAME", "msa_short_name"
    )


def by_rate(table: DataFrame) -> DataFrame:
    """Report order of area rates."""
    return sort_desc_nulls_last(table, "wfh_pct", "METFIPS")
