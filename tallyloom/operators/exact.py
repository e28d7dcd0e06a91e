"""Sums, shares and means that are the same bits on any number of partitions.

A sum is the double nearest to the true sum of its doubles, and a quotient of two sums or of a sum and a
count is rounded once more. Nothing depends on how rows are spread, merged or retried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import Grid, is_finite, limbs, rounded_once


def value_grid(df: DataFrame, values: Sequence[str]) -> Grid:
    """The digits that all finite values of some columns need; one scan of these columns."""
    sizes = [F.when(is_finite(F.col(f"`{v}`")), F.abs(F.col(f"`{v}`").cast("double"))) for v in values]
    filled = [F.when(size > 0, size) for size in sizes]
    found = df.agg(*(F.min(s) for s in filled), *(F.max(s) for s in filled)).first()
    known = [x for x in found if x is not None]
    return Grid.covering(min(known), max(known)) if known else Grid(0, 1)


def exact_sum_columns(value: Column, grid: Grid, name: str) -> list[Column]:
    """The aggregates that ``exact_sum_of`` finishes: a sum for each digit, and what is not finite."""
    value = value.cast("double")
    digits = [F.sum(d).alias(f"{name}_{i}") for i, d in enumerate(limbs(value, grid))]
    strange = F.when(~is_finite(value), value)
    return [*digits, F.sum(strange).alias(f"{name}_strange"), F.count(value).alias(f"{name}_n")]


def exact_sum_of(grid: Grid, name: str) -> Column:
    """The sum from the columns of ``exact_sum_columns``: NULL without values, else rounded once.

    NaN and infinities give what IEEE sums give, in any order.
    """
    total = rounded_once([F.col(f"{name}_{i}") for i in range(grid.n)], grid)
    return F.when(F.col(f"{name}_n") > 0, F.coalesce(F.col(f"{name}_strange"), total))


def exact_sums(
    df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], grid: Grid | None = None
) -> DataFrame:
    """Sums by group: ``keys`` and a column for each entry of ``sums`` (out -> value).

    As SQL's SUM, missing values are left out, and a group without values has no sum. Rows are
    added up in each partition before the shuffle, so a hot group costs a row per task. Pass ``grid``
    to spare the scan that looks for the range of the values.
    """
    grid = grid or value_grid(df, list(sums.values()))
    names = {out: f"__exact{i}" for i, out in enumerate(sums)}
    columns = [
        c for out, v in sums.items() for c in exact_sum_columns(F.col(f"`{v}`"), grid, names[out])
    ]
    added = df.groupBy(*keys).agg(*columns)
    return added.select(*keys, *(exact_sum_of(grid, names[out]).alias(out) for out in sums))


def exact_share_rates(
    tallies: DataFrame, keys: Sequence[str], out: str, grid: Grid | None = None
) -> DataFrame:
    """``share_rates`` from exact sums: the weighted share of each group, the same bits every time.

    ``tallies`` are those of single rows (``row_tallies``); without keys, one row.
    """
    grid = grid or value_grid(tallies, ["sum_w", "sum_w_yes"])
    added = tallies.groupBy(*keys).agg(
        *exact_sum_columns(F.col("sum_w"), grid, "__w"),
        *exact_sum_columns(F.col("sum_w_yes"), grid, "__yes"),
        F.sum("n_missing").alias("__missing"),
    )
    rate = F.try_divide(exact_sum_of(grid, "__yes"), exact_sum_of(grid, "__w"))
    return added.select(*keys, F.when(F.col("__missing") == 0, rate).alias(out))


def exact_mean_by_group(
    df: DataFrame, keys: Sequence[str], value: str, out: str, grid: Grid | None = None
) -> DataFrame:
    """``mean_by_group`` from exact sums; one missing value makes the group's mean missing."""
    grid = grid or value_grid(df, [value])
    added = df.groupBy(*keys).agg(
        *exact_sum_columns(F.col(f"`{value}`"), grid, "__x"), F.count(F.lit(1)).alias("__rows")
    )
    mean = exact_sum_of(grid, "__x") / F.col("__rows")
    return added.select(*keys, F.when(F.col("__x_n") == F.col("__rows"), mean).alias(out))


def exact_row_mean_across_series(
    panel: DataFrame, series: str, date: str, value: str, out: str, all_series: DataFrame | None = None
) -> DataFrame:
    """``row_mean_across_series`` from exact sums; NULL unless every series has a value."""
    source = panel if all_series is None else all_series
    n_series = source.agg(F.count_distinct(series)).scalar()
    grid = value_grid(panel, [value])
    added = panel.groupBy(date).agg(*exact_sum_columns(F.col(f"`{value}`"), grid, "__x"))
    mean = exact_sum_of(grid, "__x") / F.col("__x_n")
    return added.select(date, F.when(F.col("__x_n") == n_series, mean).alias(out))
