"""Dates built from parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month_to_date(year: Column, month: Column) -> Column:
    """First day of a month."""
    return F.make_date(year, month, F.lit(1))


def period_to_date(year: Column, period: Column) -> Column:
    """First day of the month named by a period code such as ``M05``.

    Annual averages carry the code ``M13``; that is no month, so they get no date.
    """
    month = F.substring(period, 2, 2)
    return F.try_to_date(F.concat(year, F.lit("-"), month, F.lit("-01")), "yyyy-MM-dd")


def week_start(moment: Column) -> Column:
    """Monday of the week. Goes through DATE, so it does not depend on the time zone."""
    return F.trunc(moment.cast("date"), "week")
