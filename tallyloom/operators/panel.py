"""Operators on panels: one value per series and date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

# Dates per window partition. Bounds the rows one task sorts for one series.
_BLOCK = 4_096


def time_axis(df: DataFrame, date: str) -> DataFrame:
    """Distinct dates with their position 0, 1, 2, ...

    Dates are made distinct in every partition, then over all of them. Only calendar days
    remain to be sorted as one array: a DATE has at most 3.7 million values, a century 36,525.
    """
    if not isinstance(df.schema[date].dataType, T.DateType):
        raise TypeError(f"{date} must be a DATE: the calendar is what bounds the axis")
    days = df.select(date).distinct().filter(F.col(date).isNotNull())
    return days.agg(F.array_sort(F.collect_list(date)).alias("__days")).select(
        F.posexplode("__days").alias("position", date)
    )


def rolling_mean(
    panel: DataFrame,
    series: Sequence[str],
    date: str,
    value: str,
    k: int,
    out: str,
    axis: DataFrame | None = None,
) -> DataFrame:
    """Mean of each value and the ``k - 1`` before it in the same series.

    Dates are counted on the axis of *all* dates in the panel, as in a table with a column
    per series: a date missing from one series is a missing value there, not a skipped row.
    The mean is NULL unless all ``k`` values are present. Two rows for one series and date
    fail the query (``duplicate_keys`` finds them). Pass ``axis`` to read the dates from a
    cheaper source than an expensive panel. A row without a date, or with one that the axis
    lacks, fails the query too.

    The grid of series and dates is never filled in: with positions on the common axis, a
    range frame of ``k`` positions and a count of its values say the same. The axis is cut
    into blocks and each row is also sent to the next block its windows reach into, so a
    long series is spread over many tasks instead of being sorted in one.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # Bounded by the calendar (see time_axis), however large the panel is.
    positions = F.broadcast(
        time_axis(panel if axis is None else axis, date).withColumnRenamed("position", "__at")
    )
    own_block = F.floor(F.col("__at") / _BLOCK)
    last_block = F.floor((F.col("__at") + k - 1) / _BLOCK)
    in_order = Window.partitionBy(*series, "__block").orderBy("__at")
    frame, same_date = in_order.rangeBetween(-(k - 1), 0), in_order.rangeBetween(0, 0)
    twice = F.raise_error(F.lit(f"more than one row for a series and {date}"))
    mean = (
        F.when(F.count(F.lit(1)).over(same_date) > 1, twice)
        .when(F.count(value).over(frame) == k, F.avg(value).over(frame))
    )
    lost = F.raise_error(F.concat(F.lit(f"{date} not on the axis: "), F.coalesce(F.col(date).cast("string"), F.lit("NULL"))))
    return (
        panel.join(positions, date, "left")
        .withColumn("__at", F.when(F.col("__at").isNotNull(), F.col("__at")).otherwise(lost))
        .withColumn("__block", F.explode(F.sequence(own_block, last_block)))
        .withColumn(out, mean)
        .filter(F.col("__block") == own_block)
        .select(*panel.columns, *([] if out in panel.columns else [out]))
    )


def row_mean_across_series(
    panel: DataFrame,
    series: str,
    date: str,
    value: str,
    out: str,
    all_series: DataFrame | None = None,
) -> DataFrame:
    """Mean over all series by date; NULL unless every series of the panel has a value.

    Long form, for any number of series: dates are aggregated with partial sums, and the
    number of series is a scalar subquery. Pass ``all_series`` to count the series in a
    cheaper source than an expensive panel.
    """
    source = panel if all_series is None else all_series
    n_series = source.agg(F.count_distinct(series)).scalar()
    return (
        panel.groupBy(date)
        .agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"))
        .select(date, F.when(F.col("__n") == n_series, F.col("__mean")).alias(out))
    )


def row_mean(wide: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Mean across columns of one row; one missing column makes it missing. No shuffle."""
    total = reduce(add, (F.col(f"`{c}`") for c in columns))
    return wide.withColumn(out, total / len(columns))


def latest_values(panel: DataFrame, series: str, date: str, value: str, out: str) -> DataFrame:
    """Value of every series on the newest date of the whole panel, NULL where it has none.

    The newest date is a scalar subquery that reads the date column only. Sort by ``out``
    descending, missing last, to order series by their latest value. Two rows of a series on
    that date fail the query.
    """
    newest = panel.agg(F.max(date)).scalar()
    on_newest = F.col(date) == newest
    twice = F.raise_error(F.lit(f"more than one row for a series and {date}"))
    latest = F.when(F.count_if(on_newest) > 1, twice).otherwise(F.max(F.when(on_newest, F.col(value))))
    return panel.groupBy(series).agg(latest.alias(out))


def share_of_total(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Percentage each row's value has of its group's total; all rows are kept.

    One missing value makes the group's shares missing, and a total of zero too.

    ``df`` is read twice; write it first if it is costly to compute.

    A window over the group would sort each group in one task. Instead the totals are added
    up (partial sums first) and joined back. They are written once to the shared folder, in a
    job that this call runs, so Spark plans the join on their true size: a broadcast if they
    are small, else a merge join whose skewed keys adaptive execution can split.
    """
    if value == out:
        raise ValueError("the share needs a name of its own")
    complete = F.count(value) == F.count(F.lit(1))
    totals = (
        df.groupBy(*keys)
        .agg(F.when(complete, F.sum(value)).alias("__total"))
        .withColumnsRenamed({k: f"__{k}" for k in keys})
    )
    totals = materialise(totals, "totals")
    same_group = reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)
    )
    return df.join(totals, same_group).select(
        *df.columns, F.try_divide(F.col(value) * 100, F.col("__total")).alias(out)
    )
