"""Working-from-home shares from published survey estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import moe_of_proportion, ratio_pct, short_place_name
from ..operators import attach_denominator, keep_listed, sort_desc_nulls_last, union_by_name
from . import fixed_values as fixed


def working_from_home(pull: DataFrame) -> DataFrame:
    """Estimates of workers who work from home beside those of all workers."""
    return attach_denominator(pull, fixed.WFH_VARIABLES, fixed.WORKERS_VARIABLE)


def stacked_estimates(*levels: DataFrame) -> DataFrame:
    """Estimates of several geographic levels as one table."""
    return union_by_name(*levels)


def shares_with_bounds(estimates: DataFrame, geographies: Sequence[str]) -> DataFrame:
    """Share in percent with its 90% bounds for the listed geographies."""
    share = ratio_pct(F.col("estimate"), F.col("summary_est"))
    margin = 100 * moe_of_proportion(
        F.col("estimate"), F.col("summary_est"), F.col("moe"), F.col("summary_moe")
    )
    return keep_listed(estimates, "GEOID", geographies).select(
        "GEOID",
        "NAME",
        short_place_name(F.col("NAME")).alias("msa_short_name"),
        share.alias("wfh_prop"),
        (share - margin).alias("wfh_90_low"),
        (share + margin).alias("wfh_90_high"),
    )


def shares(estimates: DataFrame, geographies: Sequence[str]) -> DataFrame:
    """Share in percent for the listed geographies, without bounds."""
    return shares_with_bounds(estimates, geographies).drop("wfh_90_low", "wfh_90_high")


def by_share(table: DataFrame) -> DataFrame:
    """Report order: largest share first, missing ones last, ties by code."""
    return sort_desc_nulls_last(table, "wfh_prop", "GEOID")


def area_names(shares_table: DataFrame) -> DataFrame:
    """The area dimension: code, long and short name."""
    return shares_table.select(F.col("GEOID").cast("string"), "NAME", "msa_short_name")


def area_order(names: DataFrame, total_id: str) -> DataFrame:
    """The area dimension with its column order: by code, the total last."""
    return names.withColumn("is_total", F.col("GEOID") == total_id)
