"""Weighted shares and means by group.

A weighted share is a quotient of two sums, and sums of sums are sums. So every row is
first written as a *tally* (``sum_w``, ``sum_w_yes``, ``n_missing``), tallies are added up
to any grain, and the quotient is taken last. Spark adds tallies up inside each input
partition before the shuffle, so a group that holds most of the rows sends one row per
task like any other, and a finer table of tallies can serve many coarser rates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("sum_w", "sum_w_yes", "n_missing")


def row_tallies(df: DataFrame, yes: Column, weight: Column) -> DataFrame:
    """Add the tally of each single row: the weight of a yes, the weight of any answer.

    ``n_missing`` counts rows whose contribution is unknown: no weight, or no answer with
    a weight that is not zero.
    """
    unknown = weight.isNull() | (yes.isNull() & (weight != 0))
    return df.withColumns(
        {
            "sum_w": weight,
            "sum_w_yes": F.when(yes, weight).otherwise(F.lit(0)),
            "n_missing": F.when(unknown, 1).otherwise(0),
        }
    )


def tally(tallies: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Add tallies up to the grain of ``keys``; without keys, to one row.

    A missing key is a group of its own.
    """
    return tallies.groupBy(*keys).agg(*_sums())


def _sums() -> list[Column]:
    return [F.sum(measure).alias(measure) for measure in MEASURES]


def rate() -> Column:
    """Weighted share of a tally: a fraction, NULL when unknown or when the weights sum to 0."""
    return F.when(F.col("n_missing") == 0, F.try_divide("sum_w_yes", "sum_w"))


def share_rates(tallies: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Weighted share by group. Groups without a share keep their row, with NULL."""
    return tally(tallies, keys).select(*keys, rate().alias(out))


def total_rate(tallies: DataFrame, key: str, key_value: str, out: str) -> DataFrame:
    """Weighted share over all rows: one row, with a constant key."""
    return tally(tallies).select(F.lit(key_value).alias(key), rate().alias(out))


def rates_with_total(
    tallies: DataFrame,
    by: Sequence[str],
    area: str,
    areas: Sequence,
    total_id: str,
    out: str,
    keep_missing: bool = False,
) -> DataFrame:
    """Weighted share by ``by`` and listed area, and by ``by`` over *all* areas, in one scan.

    Areas that are not listed only matter for the total, so they are folded into one group
    before the first shuffle: its size then depends on the list, not on how many areas
    exist. The grouping sets run over that small table and not over the rows. The area
    comes out as a string; groups without a share are dropped unless ``keep_missing``.
    """
    typed = [F.lit(a).cast(tallies.schema[area].dataType) for a in areas]
    folded = tally(
        tallies.withColumn(area, F.when(F.col(area).isin(typed), F.col(area))), [*by, area]
    )
    if not by:
        # A total over no rows at all is still one row; grouping sets would give none.
        neutral = tallies.sparkSession.range(1).select(
            F.lit(None).cast(tallies.schema[area].dataType).alias(area),
            *(F.lit(0).cast(folded.schema[m].dataType).alias(m) for m in MEASURES),
        )
        folded = folded.unionByName(neutral)
    keys = [F.col(k) for k in by]
    total = F.grouping(area)
    rates = (
        folded.groupingSets([[*keys, F.col(area)], keys], *keys, F.col(area))
        .agg(total.alias("__total"), *_sums())
        .filter((F.col("__total") == 1) | F.col(area).isNotNull())
        .select(
            *by,
            F.when(F.col("__total") == 1, F.lit(total_id))
            .otherwise(F.col(area).cast("string"))
            .alias(area),
            rate().alias(out),
        )
    )
    return rates if keep_missing else rates.filter(F.col(out).isNotNull())


def mean_by_group(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Plain mean by group; one missing value makes the group's mean missing."""
    complete = F.count(value) == F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.when(complete, F.avg(value)).alias(out))
