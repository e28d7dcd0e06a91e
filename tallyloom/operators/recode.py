"""Recoding numeric codes, and labels of codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recode_ranges(
    df: DataFrame,
    column: str,
    ranges: Sequence[tuple[int, int, str]],
    out: str,
) -> DataFrame:
    """Label an integer code by the inclusive range ``(low, high, label)`` it falls in.

    Several ranges may carry one label. A code in no range gets NULL. Ranges must not
    overlap, so their order never matters.

    Codes and ranges are joined on equality of a bucket, with the bounds as a further condition:
    a join on ``low <= code <= high`` alone would compare every row with every range, and a
    long conditional expression is inlined into each filter on its result. Buckets are as
    wide as it takes for the ranges to cover a few buckets each, so the table that Spark joins
    grows with the number of ranges, not with their width.
    """
    _require_disjoint(ranges)
    shift = _bucket_bits(ranges)
    rows = [
        (bucket, low, high, label)
        for low, high, label in ranges
        for bucket in range(low >> shift, (high >> shift) + 1)
    ]
    names = ["__bucket", "__low", "__high", out]
    # An Arrow table becomes a local relation, whose size Spark knows when it plans the join.
    whole = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    entries = pa.table(dict(zip(names, [*whole, pa.array([r[3] for r in rows], pa.string())])))
    dimension = df.sparkSession.createDataFrame(entries)
    code = F.col(f"`{column}`").cast("long")
    inside = (F.shiftright(code, shift) == F.col("__bucket")) & code.between(F.col("__low"), F.col("__high"))
    return df.join(dimension, inside, "left").drop("__bucket", "__low", "__high")


def _bucket_bits(ranges: Sequence[tuple[int, int, str]]) -> int:
    """The least number of low bits to leave out for ranges to cover four buckets each on average."""
    for shift in range(64):
        if sum((high >> shift) - (low >> shift) + 1 for low, high, _ in ranges) <= 4 * len(ranges):
            return shift
    return 63


def _require_disjoint(ranges: Sequence[tuple[int, int, str]]) -> None:
    ordered = sorted(ranges)
    for low, high, label in ordered:
        if low > high:
            raise ValueError(f"empty range {low}-{high} for {label!r}")
    for (_, end, first), (start, _, second) in zip(ordered, ordered[1:]):
        if start <= end:
            raise ValueError(f"ranges of {first!r} and {second!r} overlap at {start}")


def label_codes(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code, NULL for a code without one."""
    entries = [F.lit(text) for entry in labels.items() for text in entry]
    return F.try_element_at(F.create_map(*entries), code)
