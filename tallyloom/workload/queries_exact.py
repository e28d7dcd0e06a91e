"""Queries whose doubles are the same bits on any number of partitions: nothing is rounded.

Weights and values are quotients, so that almost no sum of them is a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..plans import fixed_values as fixed
from ..plans import telework
from ..session import materialise
from . import views
from .queries import registered
from .views import TOTAL_ID, table

# Numbers of rows that a long window spans.
LONG_WINDOW = 1_000


def _fine_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = views.persons(spark, sf_dir)
    return telework.person_tallies(persons.withColumn("WTFINL", F.col("WTFINL") / 7))


@registered
def exact_weighted_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exact_share_rates(_fine_tallies(spark, sf_dir), ["IND", "METFIPS"], "rate")


@registered
def exact_weighted_share_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = op.exact_share_rates(_fine_tallies(spark, sf_dir), [], "rate")
    return rates.select(F.lit(TOTAL_ID).alias("METFIPS"), "rate")


@registered
def exact_sums_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and taxes of very different size, on one grid of digits."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("value"),
        (F.col("l_tax") / 1_024_000).alias("small"),
    )
    return op.exact_sums(lines, ["l_suppkey"], {"sum_value": "value", "sum_small": "small"})


@registered
def exact_mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by part; one missing price makes a part's mean missing."""
    price = F.when(F.col("l_quantity") < 49, F.col("l_extendedprice") / 3)
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", price.alias("price"))
    return op.exact_mean_by_group(lines, ["l_partkey"], "price", "mean_price")


def _exact_city_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of quantities, which are whole: the same in any order of adding."""
    return materialise(views.city_panel(spark, sf_dir), "city-panel")


@registered
def exact_rolling_mean_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing means by supplier and week."""
    panel = materialise(views.supplier_panel(spark, sf_dir), "supplier-panel")
    return op.exact_rolling_mean(
        panel, ["l_suppkey"], "data_week", "occupancy", fixed.ROLLING_WEEKS, "mean4"
    )


@registered
def exact_row_mean_across_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _exact_city_panel(spark, sf_dir)
    rolled = op.exact_rolling_mean(
        panel, ["city"], "data_week", "occupancy", fixed.ROLLING_WEEKS, "mean4"
    )
    return op.exact_row_mean_across_series(
        materialise(rolled, "city-rolled"), "city", "data_week", "mean4", "mean_of_cities", panel
    )


@registered
def trailing_mean_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over a thousand orders of one series, with missing rows and missing prices."""
    key = F.col("o_orderkey")
    orders = (
        table(spark, sf_dir, "orders")
        .filter(key % 4_999 != 0)
        .select(
            F.when(key % 4 == 3, "some").otherwise("most").alias("series"),
            F.when(key % 4 == 3, F.floor(key / 4)).otherwise(key - F.floor(key / 4)).alias("position"),
            F.when(key % 3_301 != 0, F.col("o_totalprice") / 7).alias("price"),
        )
    )
    return op.trailing_mean(orders, ["series"], "position", "price", LONG_WINDOW, "mean")


@registered
def range_lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of line items in ranges from the orders, one for each, and in one very wide range."""
    key = F.col("o_orderkey")
    ranges = table(spark, sf_dir, "orders").select(
        (key * 100).alias("low"),
        (key * 100 + key % 90).alias("high"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_custkey").alias("owner"),
    )
    wide = spark.range(1).select(
        F.lit(-(2**31)).alias("low"),
        F.lit(-1).cast("long").alias("high"),
        F.lit("wide").alias("label"),
        F.lit(None).cast("long").alias("owner"),
    )
    code = (
        F.when(F.col("l_returnflag") == "R", -F.col("l_partkey") * 10_000_019)
        .when(F.col("l_tax") > 0, F.col("l_orderkey") * 100 + F.col("l_partkey") % 100)
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
    return op.lookup_ranges(lines, "code", op.union_by_name(ranges, wide))
