"""Queries whose results hold their order as a column, so that a wrong sort shows.

Doubles are rounded before they are sorted by, since engines differ in the last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..plans import estimates, telework
from . import queries as q
from .queries import registered


@registered
def positions_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, largest price first and missing ones last, numbered over ranges of the order."""
    orders = q.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return op.with_positions(
        orders.select("o_orderkey", price.alias("price")), [F.desc_nulls_last("price"), "o_orderkey"]
    )


@registered
def positions_missing_key_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by sector and year, rows without a sector last."""
    return op.number_rows(q.grouped_with_missing_key(spark, sf_dir))


@registered
def positions_wfh_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order of the shares with bounds."""
    return op.number_rows(estimates.by_share(q.wfh_share_with_bounds(spark, sf_dir)))


@registered
def positions_wfh_share_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order of the shares by county."""
    return op.number_rows(estimates.by_share(q.wfh_share_by_county(spark, sf_dir)))


@registered
def positions_telework_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order of monthly rates: areas by month, then the total by month."""
    return op.number_rows(telework.by_month(q.telework_monthly_long(spark, sf_dir)))


@registered
def positions_telework_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order of the rates by sector."""
    return op.number_rows(telework.by_total_rate(q.telework_by_sector(spark, sf_dir), "total"))


@registered
def positions_office_telework_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report order of the rates by area."""
    return op.number_rows(telework.by_rate(q.office_telework_by_area(spark, sf_dir)))
