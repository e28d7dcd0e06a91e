"""Checks of preconditions. Each returns the offending rows and collects nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def wrong_piece_count(df: DataFrame, label: Column, pieces: int, delimiter: str = "|") -> DataFrame:
    """Rows whose label is present but does not have exactly ``pieces`` pieces."""
    found = F.size(F.split(label, r"\Q" + delimiter + r"\E", -1))
    return df.filter(label.isNotNull() & (found != pieces))
