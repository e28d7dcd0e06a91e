"""Filters that keep rows; none keeps a row whose value is missing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_BYTES = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def keep_listed(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is in a list.

    Each value takes the type of the column by itself, so that codes given as text, as numbers
    or mixed find integer codes. A list of any length is one ``IN`` predicate, which Spark
    keeps as a hash set beyond a few values and which reaches the scan. Whole numbers and texts
    are converted here, once; values of other types are cast by Spark.
    """
    type_ = df.schema[column].dataType
    known = [v for v in dict.fromkeys(values) if v is not None]
    if isinstance(type_, T.IntegralType):
        # No column of the type holds a number beyond its range.
        most = 1 << 8 * _BYTES[type(type_)] - 1
        whole = [str(v) for v in dict.fromkeys(map(int, known)) if -most <= v < most]
        # One call for the whole list: a call for each value takes longer than the query.
        name = column.replace("`", "``")
        return df.filter(F.expr(f"`{name}` IN ({', '.join(whole)})") if whole else F.lit(False))
    if isinstance(type_, T.StringType):
        return df.filter(F.col(column).isin([str(v) for v in known]))
    return df.filter(F.col(column).isin([F.lit(v).cast(type_) for v in known]))


def keep_dates(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows from the first through the last day (``YYYY-MM-DD``), both included.

    The column itself is compared with two literals, so files and row groups outside the
    range can be skipped. The upper bound is the day after, which also keeps the last day's
    hours of a timestamp.
    """
    after = dt.date.fromisoformat(last) + dt.timedelta(days=1)
    type_ = df.schema[column].dataType
    start, end = (F.lit(dt.date.fromisoformat(first)), F.lit(after))
    return df.filter((F.col(column) >= start.cast(type_)) & (F.col(column) < end.cast(type_)))
