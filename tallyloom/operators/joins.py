"""Joins to dimensions, null-safe joins, and denominators.

No join here carries a broadcast hint. Spark broadcasts a side when the size it knows
(files on disk, or a finished stage under adaptive execution) is below the session's
threshold, and otherwise sorts and merges with its own handling of skewed keys. A hint
would force the broadcast of a dimension that has grown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_lookup(df: DataFrame, lookup: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inner join on keys of the same name; the key appears once."""
    return df.join(lookup, key, "inner")


def join_dimension(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """Inner join on keys of different names; keeps the left name and drops the right one."""
    return df.join(dimension, df[key] == dimension[dimension_key], "inner").drop(
        dimension[dimension_key]
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on several keys in which a missing key matches a missing key."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    matches = reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys)
    )
    return left.join(renamed, matches, "inner").drop(*(f"__right_{k}" for k in keys))


def attach_denominator(
    pull: DataFrame,
    variables: Mapping[str, str],
    denominator: str,
    keys: Sequence[str] = ("GEOID", "NAME"),
) -> DataFrame:
    """Rows of the named variables, each beside the estimate of the denominator variable.

    ``pull`` has one row per geography and variable: keys, ``variable``, ``estimate``,
    ``moe``. ``variables`` maps the wanted names to codes of the pull. A geography without
    a denominator row keeps its rows, with a missing denominator. Two rows of one variable
    for a geography fail the query.

    One conditional aggregate per geography replaces a self join: a single scan, partial
    sums before the only shuffle, and a row per geography however many rows it had.
    """
    code = F.col("variable")

    def value_of(wanted: str, column: str) -> Column:
        twice = F.raise_error(F.lit(f"more than one row of {wanted} for a geography"))
        return F.when(F.count_if(code == wanted) > 1, twice).otherwise(
            F.max(F.when(code == wanted, F.col(column)))
        )

    wide = (
        pull.filter(code.isin([*variables.values(), denominator]))
        .groupBy(*keys)
        .agg(
            value_of(denominator, "estimate").alias("summary_est"),
            value_of(denominator, "moe").alias("summary_moe"),
            *(
                F.struct(
                    F.count_if(code == wanted).alias("n"),
                    F.lit(name).alias("variable"),
                    value_of(wanted, "estimate").alias("estimate"),
                    value_of(wanted, "moe").alias("moe"),
                ).alias(f"__v{i}")
                for i, (name, wanted) in enumerate(variables.items())
            ),
        )
    )
    rows = F.explode(F.array(*(F.col(f"__v{i}") for i in range(len(variables)))))
    return (
        wide.select(*keys, rows.alias("__v"), "summary_est", "summary_moe")
        .filter(F.col("__v.n") > 0)
        .select(*keys, "__v.variable", "__v.estimate", "__v.moe", "summary_est", "summary_moe")
    )
