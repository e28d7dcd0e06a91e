"""Slices of an ordered catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalogue_from_match(
    catalogue: DataFrame, ordinal: str, description: str, wanted: str
) -> DataFrame:
    """Entries from the first one with the wanted description through the last.

    Rows of a distributed table have no position, so the catalogue carries an ordinal. The
    start is a scalar subquery with the description pushed to the scan. A description that
    occurs nowhere fails the query: an empty slice would look like an empty catalogue.
    """
    first = F.min(ordinal)
    start = (
        catalogue.filter(F.col(description) == wanted)
        .agg(
            F.when(first.isNotNull(), first).otherwise(
                F.raise_error(F.lit(f"no catalogue entry is described as {wanted!r}"))
            )
        )
        .scalar()
    )
    return catalogue.filter(F.col(ordinal) >= start)
