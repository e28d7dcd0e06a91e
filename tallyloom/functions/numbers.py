"""Numbers: safe casts, ratios and their margins of error.

Missing is always NULL, never NaN, so that ``isNotNull`` and the sort order mean the same
everywhere. Divisions by zero give NULL and do not raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_double(text: Column) -> Column:
    """Text to double; text that is no decimal number gives NULL.

    The shape is tested first. The cast alone would take ``12d``, ``NaN`` and ``Infinity``
    for numbers, and it raises and catches an exception for every text it cannot read.
    """
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; NULL when either is missing or the whole is zero."""
    return F.try_divide(part, whole)


def ratio_pct(part: Column, whole: Column) -> Column:
    """``ratio`` as a percentage."""
    return ratio(part, whole) * 100


def moe_of_proportion(part: Column, whole: Column, moe_part: Column, moe_whole: Column) -> Column:
    """Margin of error of the proportion ``p = part / whole``.

    This is the published formula for derived proportions: the root of
    ``moe_part^2 - p^2 * moe_whole^2`` over the whole, with a plus sign in place of the
    minus where the difference is negative (the formula for ratios).
    """
    p = ratio(part, whole)
    own = moe_part * moe_part
    carried = p * p * moe_whole * moe_whole
    radicand = F.when(own >= carried, own - carried).when(own < carried, own + carried)
    return F.try_divide(F.sqrt(radicand), whole)


def plain_number(number: Column) -> Column:
    """Text of a double for a report: whole numbers without a trailing ``.0``."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
