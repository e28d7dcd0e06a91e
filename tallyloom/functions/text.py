"""Text: place names, labelled codes, fixed-width codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_place_name(name: Column) -> Column:
    """The part of a place name before its first hyphen or comma.

    ``New York-Newark, NY Metro Area`` gives ``New York``; a name with neither is kept.
    """
    return F.substring_index(F.substring_index(name, "-", 1), ",", 1)


def split_labels(label: Column, names: Sequence[str], delimiter: str = "|") -> list[Column]:
    """One column per piece of a delimited label; a missing label gives missing pieces.

    A label with another number of pieces than ``names`` fails the query, because filling
    or cutting it would silently shift codes into names.
    """
    pieces = F.split(label, _literal_pattern(delimiter), -1)
    wrong = F.raise_error(
        F.concat(F.lit(f"expected {len(names)} pieces in label: "), label)
    ).cast("string")
    # NULL <> n is NULL, so a missing label falls through to the (missing) piece.
    return [
        F.when(F.size(pieces) != F.when(label.isNotNull(), len(names)), wrong)
        .otherwise(F.get(pieces, F.lit(i)))
        .alias(name)
        for i, name in enumerate(names)
    ]


def _literal_pattern(delimiter: str) -> str:
    return r"\Q" + delimiter + r"\E"


def code_slices(code: Column, layout: Sequence[tuple[str, int, int]]) -> list[Column]:
    """Cut a fixed-width code into named pieces.

    ``layout`` holds ``(name, first, last)`` with 1-based inclusive positions; pieces may
    overlap. Pieces stay strings, so leading zeros survive.
    """
    return [
        F.substring(code, first, last - first + 1).alias(name) for name, first, last in layout
    ]


def blank_to_null(text: Column) -> Column:
    """An empty string is a missing value."""
    return F.nullif(text, F.lit(""))
