"""Fixed-width text, such as survey microdata extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank_to_null


def read_fixed_width(
    spark: SparkSession, path: str, layout: Sequence[tuple]
) -> DataFrame:
    """Lines cut by ``layout``: ``(name, first, last, type)``, 1-based and inclusive.

    A fifth entry is the number of implied decimals: ``00123`` with 2 of them is 1.23. Padding
    is removed, a blank field is missing, and so is one that does not fit its type. Only the
    columns a query uses are cut and cast.
    """
    def field(name: str, first: int, last: int, type_name: str, decimals: int = 0):
        text = blank_to_null(F.trim(F.substring("value", first, last - first + 1)))
        value = text if type_name == "string" else text.try_cast(type_name)
        return (value / 10**decimals if decimals else value).alias(name)

    return spark.read.text(path).select(*(field(*entry) for entry in layout))
