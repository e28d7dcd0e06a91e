"""Long to wide, row binding, and reproducible order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_values(df: DataFrame, column: str, order_by: Sequence[str]) -> list[str]:
    """Distinct values of a column, in order of their first appearance by ``order_by``.

    For the columns of a wide table, whose names the planner must know. Only names come to
    the driver; more of them than ``spark.sql.pivotMaxValues`` is an error, never a cut.
    """
    max_values = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    first = F.min(F.struct(*order_by)).alias("__first")
    rows = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(first)
        .orderBy("__first", column)
        .limit(max_values + 1)
        .collect()
    )
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} values, too many for columns")
    return [row[column] for row in rows]


def pivot_ordered(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str]
) -> DataFrame:
    """Long to wide with a column per entry of ``names``, in that order; empty cells are NULL.

    Two rows for one cell fail the query: picking one would hide the duplicate. So does a row
    whose name is missing or not in ``names``: filter before to leave rows out. The explicit
    list spares Spark the job that looks for values, and each cell is reduced to one row
    before the rows of an id meet, so a wide id is never large.
    """
    name = F.col(f"`{names_from}`")
    stray = F.raise_error(F.concat(F.lit(f"{names_from} not among the columns: "), F.coalesce(name.cast("string"), F.lit("NULL"))))
    df = df.withColumn(names_from, F.when(name.isin(list(names)), name).otherwise(stray))
    cell = F.when(F.count(F.lit(1)) <= 1, F.max(values_from)).otherwise(
        F.raise_error(F.lit(f"more than one row for a cell of {values_from} by {names_from}"))
    )
    return df.groupBy(*ids).pivot(names_from, list(names)).agg(cell)


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack rows by column name; a column one side lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def sort_desc_nulls_last(df: DataFrame, by: str | Column, *ties: str | Column) -> DataFrame:
    """Sort descending with missing values last.

    Name tie-breakers that make the order unique: it is then the same on every run, and rows
    of one hot value still spread over the sorted partitions.
    """
    main = F.col(by) if isinstance(by, str) else by
    return df.orderBy(main.desc_nulls_last(), *ties)
