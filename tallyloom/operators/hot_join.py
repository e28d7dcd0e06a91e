"""Null-safe joins in which a few keys, such as missing ones, hold much of both sides.

A join sends all rows of a key to one task. Adaptive execution can cut a hot key on one side, against
the whole other side. Here both sides of a hot key are cut: ``a`` parts of one and ``b`` of the
other meet in ``a * b`` cells, each row going to the cells of its own part. Which keys are hot is
told by a summary of frequent items (Misra and Gries) of each side, of fixed size for any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .joins import join_null_safe

# Items that a summary keeps. It counts each key short by at most rows / (items * 3 / 4).
SUMMARY_ITEMS = 4_096
# Keys of a side that may be called hot.
MOST_HOT = 1_024


def key_hash(keys: Sequence[str]) -> Column:
    """A number for a pair of keys; a missing key counts as a value of its own."""
    known = [F.col(f"`{k}`").isNotNull() for k in keys]
    return F.xxhash64(*(F.col(f"`{k}`") for k in keys), *known)


def frequent_keys(df: DataFrame, keys: Sequence[str], least: int) -> dict[int, int]:
    """Hashes of keys that may have ``least`` rows or more, with about how many they have.

    One scan with partial summaries, which merge; a bounded list comes to the driver. No key with more
    rows than ``least`` and than the summary's error is left out.
    """
    # Spark keeps the summary itself: its frequent-items sketch follows Misra and Gries.
    top = F.call_function("approx_top_k", key_hash(keys), F.lit(MOST_HOT), F.lit(SUMMARY_ITEMS))
    found = df.agg(top.alias("top"))
    return {row["item"]: row["count"] for row in found.first()["top"] if row["count"] >= least}


@dataclass(frozen=True)
class Cells:
    """Into how many parts the rows of each hot key are cut: on the left, and on the right."""

    parts: dict[int, tuple[int, int]]

    @classmethod
    def of(cls, left: dict[int, int], right: dict[int, int], rows_per_part: int) -> Cells:
        def cut(n: int) -> int:
            return max(1, -(-n // rows_per_part))

        return cls({h: (cut(left.get(h, 0)), cut(right.get(h, 0))) for h in left.keys() | right.keys()})

    def column(self, hashed: Column, side: int) -> Column:
        pairs = [F.lit(x) for h, p in self.parts.items() for x in (h, p[side])]
        return F.element_at(F.create_map(*pairs), hashed)


def _hot_rows(df: DataFrame, keys: Sequence[str], cells: Cells, own: int, label: str) -> DataFrame:
    """The rows of hot keys with their part, once for each part of the other side.

    Written once, so that a row keeps its part when a task is run again.
    """
    hashed = key_hash(keys)
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = df.filter(hashed.isin(list(cells.parts))).withColumn("__hash", hashed)
    rows = materialise(
        rows.withColumn("__own", F.pmod(number, cells.column(F.col("__hash"), own)).cast("int")), label
    )
    others = cells.column(F.col("__hash"), 1 - own)
    sides = ("__l", "__r") if own == 0 else ("__r", "__l")
    return rows.withColumn(sides[1], F.explode(F.sequence(F.lit(0), others - 1))).withColumnRenamed(
        "__own", sides[0]
    )


def join_null_safe_hot(
    left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_part: int | None = None
) -> DataFrame:
    """``join_null_safe`` for tables in which some keys hold very many rows on both sides.

    ``rows_per_part`` is the number of rows of a side that meet in one cell; a key with more is
    hot. By default it is a sixteenth of the larger side's rows for each shuffle partition. Keys that
    are not hot join as usual. A hot key's rows are copied once for each part of the other side and
    never more, so a key that is hot on one side only copies the few rows of the other. The rows of
    hot keys are written once; each side is read three times, so write it first if it is costly.
    """
    spark = left.sparkSession
    n_left, n_right = left.count(), right.count()
    if rows_per_part is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows_per_part = max(1, max(n_left, n_right) // (16 * partitions))
    hot_left = frequent_keys(left, keys, rows_per_part)
    hot_right = frequent_keys(right, keys, rows_per_part)
    cells = Cells.of(hot_left, hot_right, rows_per_part)
    cells = Cells({h: p for h, p in cells.parts.items() if p != (1, 1)})
    if not cells.parts:
        return join_null_safe(left, right, keys)
    cold = ~key_hash(keys).isin(list(cells.parts))
    joined = join_null_safe(left.filter(cold), right.filter(cold), keys)
    met = join_null_safe(
        _hot_rows(left, keys, cells, 0, "hot-left"),
        _hot_rows(right, keys, cells, 1, "hot-right").drop("__hash"),
        ["__l", "__r", *keys],
    )
    return joined.unionByName(met.drop("__l", "__r", "__hash"))
