"""Office attendance: smoothed weekly panel, and attendance against telework."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import (
    join_dimension,
    keep_dates,
    mean_by_group,
    pivot_ordered,
    rolling_mean,
    row_mean,
)
from . import fixed_values as fixed


def weekly_means_wide(
    panel: DataFrame,
    cities: Sequence[str],
    first_week: str = fixed.FIRST_WEEK,
    weeks: int = fixed.ROLLING_WEEKS,
    mean_name: str = fixed.MEAN_OF_METROS,
    axis: DataFrame | None = None,
) -> DataFrame:
    """Trailing mean per city and their mean, a column per city, from ``first_week`` on.

    The cut-off comes after the smoothing, so the first weeks kept still see the weeks
    before them. The mean over cities is taken across the finished columns, which needs no
    further shuffle.
    """
    smoothed = rolling_mean(panel, ["city"], "data_week", "occupancy", weeks, "occupancy_mean", axis)
    kept = smoothed.filter(F.col("data_week") >= F.lit(first_week).cast("date"))
    wide = pivot_ordered(kept, ["data_week"], "city", "occupancy_mean", cities)
    return row_mean(wide, cities, mean_name)


def newest_first(wide: DataFrame) -> DataFrame:
    """Report order of the weekly panel."""
    return wide.orderBy(F.col("data_week").desc())


def columns_by_latest(wide: DataFrame) -> DataFrame:
    """The weekly panel with its series ordered by their newest value, largest first.

    Missing values go last and ties keep their order. Only the newest row, one value per
    column, comes to the driver: the order of columns has to be known to plan the rest.
    """
    newest = wide.orderBy(F.col("data_week").desc()).first()
    series = [c for c in wide.columns if c != "data_week"]
    if newest is not None:
        series.sort(key=lambda c: (newest[c] is None, -(newest[c] or 0.0)))
    return wide.select("data_week", *(F.col(f"`{c}`") for c in series))


def attendance_and_telework(
    panel: DataFrame, rates: DataFrame, first: str, last: str
) -> DataFrame:
    """Mean attendance of each city between two dates beside its telework rate."""
    compared = keep_dates(panel, "data_week", first, last)
    means = mean_by_group(compared, ["city"], "occupancy", "occupancy_mean")
    return (
        join_dimension(means, rates, "city", "msa_short_name")
        .withColumnsRenamed({"occupancy_mean": fixed.OCCUPANCY_NAME, "wfh_pct": fixed.TELEWORK_NAME})
        .select("city", fixed.OCCUPANCY_NAME, "METFIPS", fixed.TELEWORK_NAME, "NAME")
    )
