"""Order as data: the position of every row, and running totals over an order.

A window without a partition puts all rows into one task. Here rows are cut into blocks by ranges
of the order; each block is sorted and numbered by its own task. What all earlier blocks add up to is
carried in from a table of one row per block. Both levels together are the running total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# Spark numbers rows as (partition << 33) + (row of the partition).
_ROW_BITS = 33
# Blocks whose totals one task adds up in order; their own totals are added up above that.
_SUPER = 4_096


def present_blocks(df: DataFrame) -> DataFrame:
    """Rows in the order they are in, written once, with ``__block`` and ``__row``.

    Rows of a higher block come after all rows of a lower one; ``__row`` counts from 0 inside a block.
    """
    placed = (
        df.withColumn("__number", F.monotonically_increasing_id())
        .withColumn("__block", F.shiftright("__number", _ROW_BITS))
        .withColumn("__row", F.col("__number").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("__number")
    )
    return materialise(placed, "blocks")


def sorted_blocks(
    df: DataFrame,
    order: Sequence[str | Column],
    blocks: int | None = None,
    spread_ties: bool = True,
) -> DataFrame:
    """Rows in the given order as ``present_blocks``, one block for each range of the order.

    ``order`` names columns, or columns with ``asc_nulls_last`` and the like. Rows equal in the
    whole order are spread over blocks too, in no set order, so that no block is hot; without
    ``spread_ties`` they share a block. ``blocks`` is the session's number of shuffle partitions
    unless given. ``df`` is read twice, once for a sample of its keys; write it first if it is
    costly to compute.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return present_blocks(_sorted(df, order, n, spread_ties))


def _sorted(df: DataFrame, order: Sequence[str | Column], n: int, spread_ties: bool) -> DataFrame:
    part = "__part"
    while part in df.columns:
        part += "_"
    # The number of the row in the input parts equal rows; it takes no other part.
    parted = df.withColumn(part, F.xxhash64(F.monotonically_increasing_id()))
    keys = [*order, part] if spread_ties else list(order)
    return parted.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(part)


def block_carries(totals: DataFrame, block: str, values: Mapping[str, str]) -> DataFrame:
    """What all earlier blocks add up to: ``block`` and a column for each entry (out -> total).

    ``totals`` has a row for each block. Blocks are added up in groups of 4,096. The sums of the
    groups, which are as few, meet in one row, where each gets those before it.
    """
    group = F.floor(F.col(block) / _SUPER)
    sums = [F.sum(v).alias(f"__{out}") for out, v in values.items()]
    groups = totals.groupBy(group.alias("__block_group")).agg(*sums)
    listed = F.array_sort(F.collect_list(F.struct("__block_group", *(f"__{out}" for out in values))))

    def added(entries: Column, name: str) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda total, e: total + e[name]).alias(name)

    def before(entry: Column, place: Column) -> Column:
        earlier = F.slice("__all", F.lit(1), place)
        return F.struct(
            entry["__block_group"].alias("__of"), *(added(earlier, f"__{out}") for out in values)
        )

    above = groups.agg(listed.alias("__all")).select(F.inline(F.transform("__all", before)))
    inside = Window.partitionBy("__block_group").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("__block_group", group)
        .join(above, F.col("__block_group") == F.col("__of"))
        .select(
            block,
            *(
                (F.col(f"__{out}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out)
                for out, v in values.items()
            ),
        )
    )


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    """Rows as one column, so that no name of theirs meets one of the blocks'."""
    record = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("__record")
    blocks = present_blocks(rows.select(record))
    totals = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    carries = block_carries(totals, "__block", {"__before": "__n"})
    return blocks.join(carries, "__block").select(
        *(F.col(f"__record.`{c}`").alias(c) for c in rows.columns if c != out),
        (F.col("__before") + F.col("__row") + 1).cast("long").alias(out),
    )


def number_rows(df: DataFrame, out: str = "position") -> DataFrame:
    """Adds the position 1, 2, 3, ... of each row in the order that ``df`` has, as after a sort.

    The order of a table as a column: it can be stored, joined and compared, where the order of rows
    is lost in the next shuffle. No shuffle of the rows; they are written once.
    """
    return _numbered(df, out)


def with_positions(
    df: DataFrame, order: Sequence[str | Column], out: str = "position", blocks: int | None = None
) -> DataFrame:
    """Adds the position 1, 2, 3, ... of each row in an order, over all rows.

    Rows equal in the whole order get neighbouring positions in no set order, so name ties that make
    the order unique. One range shuffle and one written table; an empty table stays empty.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _numbered(_sorted(df, order, n, True), out)
