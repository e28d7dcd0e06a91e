"""Trailing means over windows of any length, without sending a row anywhere but to its place.

The sum of a window is the difference of two running totals. Totals run over all rows in the order of
series and position, cut into blocks: inside a block by a window, across blocks by a carry of one row
per block. A series may span any number of blocks, so one that holds most rows is no hot group. Running
totals are kept as exact limbs, so differences lose nothing, however long the table is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import limbs, rounded_once
from .exact import value_grid
from .panel import time_axis
from .positions import block_carries, sorted_blocks

# Rows of a block, which one task adds up.
BLOCK_ROWS = 1 << 20


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)), F.lit(True))


def trailing_mean(
    panel: DataFrame, series: Sequence[str], position: str, value: str, k: int, out: str
) -> DataFrame:
    """Mean of each value and those at the ``k - 1`` positions before it in the same series.

    ``position`` is a whole number. The mean is NULL unless all ``k`` positions have a row with a
    value. It is the nearest double to the true sum, divided by ``k``: the same bits as adding the
    window up by itself would give, on any number of partitions. A value that is NaN or infinite counts
    as missing. Two rows for one series and position, or a row without a position, fail the query. A
    missing series key is a series of its own.

    Rows go through one sort by range and are joined once, by their number in that order: the first
    row of a full window stands ``k - 1`` rows before its last. Neither depends on ``k``. ``panel`` is
    read three times; write it first if it is costly to compute.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    grid = value_grid(panel, [value])
    own = [f"__s{i}" for i in range(len(series))]
    lost = F.raise_error(F.lit(f"a row without {position}"))
    at = F.col(f"`{position}`").cast("long")
    rows = panel.select(
        F.struct(*(F.col(f"`{c}`") for c in panel.columns)).alias("__record"),
        *(F.col(f"`{s}`").alias(o) for s, o in zip(series, own)),
        F.when(at.isNotNull(), at).otherwise(lost).alias("__at"),
        F.when(F.abs(F.col(f"`{value}`").cast("double")) < float("inf"), F.col(f"`{value}`").cast("double")).alias("__x"),
    )
    n_rows = panel.count()
    least = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys are unique, so ranges of them are even, and equal ones meet in one block.
    blocks = sorted_blocks(rows, [*own, "__at"], max(least, -(-n_rows // BLOCK_ROWS)), spread_ties=False)
    digits = [f"__d{i}" for i in range(grid.n)]
    blocks = blocks.withColumns(dict(zip(digits, limbs(F.coalesce("__x", F.lit(0.0)), grid))))
    blocks = blocks.withColumn("__one", F.when(F.col("__x").isNotNull(), 1).otherwise(0).cast("long"))
    measures = [*digits, "__one"]
    totals = blocks.groupBy("__block").agg(
        *(F.sum(m).alias(m) for m in measures), F.count(F.lit(1)).alias("__rows")
    )
    carried = {f"{m}_before": m for m in measures} | {"__first": "__rows"}
    carries = block_carries(totals, "__block", carried)
    in_block = Window.partitionBy("__block").orderBy("__row")
    running = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_key = _same(
        [F.lag(c).over(in_block) for c in [*own, "__at"]], [F.col(c) for c in [*own, "__at"]]
    )
    twice = F.raise_error(F.lit(f"more than one row for a series and {position}"))
    not_first = F.col("__row") > 0
    summed = blocks.select(
        "__record",
        *own,
        F.when(not_first & same_key, twice.cast("long")).otherwise(F.col("__at")).alias("__at"),
        "__block",
        "__row",
        *measures,
        *(F.sum(m).over(running).alias(f"{m}_run") for m in measures),
    )
    placed = summed.join(carries, "__block").select(
        "__record",
        *own,
        "__at",
        (F.col("__first") + F.col("__row")).alias("__place"),
        *((F.col(f"{m}_run") + F.col(f"{m}_before")).alias(f"{m}_to") for m in measures),
        *((F.col(f"{m}_run") + F.col(f"{m}_before") - F.col(m)).alias(f"{m}_from") for m in measures),
    )
    first = placed.select(
        (F.col("__place") + (k - 1)).alias("__last"),
        (F.col("__at") + (k - 1)).alias("__until"),
        *(F.col(o).alias(f"{o}_first") for o in own),
        *(f"{m}_from" for m in measures),
    )
    met = placed.drop(*(f"{m}_from" for m in measures)).join(
        first, F.col("__place") == F.col("__last"), "left"
    )
    full = (
        (F.col("__at") == F.col("__until"))
        & _same([F.col(o) for o in own], [F.col(f"{o}_first") for o in own])
        & (F.col("__one_to") - F.col("__one_from") == k)
    )
    total = rounded_once([F.col(f"{d}_to") - F.col(f"{d}_from") for d in digits], grid)
    return met.select(
        *(F.col(f"__record.`{c}`").alias(c) for c in panel.columns if c != out),
        F.when(full, total / F.lit(float(k))).alias(out),
    )


def exact_rolling_mean(
    panel: DataFrame,
    series: Sequence[str],
    date: str,
    value: str,
    k: int,
    out: str,
    axis: DataFrame | None = None,
) -> DataFrame:
    """``rolling_mean`` by ``trailing_mean``: dates count on the axis of all dates of the panel.

    A row without a date, or with one that the axis lacks, fails the query.
    """
    days = time_axis(panel if axis is None else axis, date)
    days = days.select(F.col(date).alias("__day"), F.col("position").cast("long").alias("__position"))
    # Bounded by the calendar (see time_axis).
    placed = panel.join(F.broadcast(days), F.col(f"`{date}`") == F.col("__day"), "left").drop("__day")
    found = trailing_mean(placed, series, "__position", value, k, out)
    return found.drop("__position")
