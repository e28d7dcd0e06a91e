"""Looking codes up in a table of ranges of any number and any width.

A range of whole numbers is cut into dyadic intervals: runs of ``2 ** level`` numbers that start at a
multiple of their length, two of each level at most. A code lies in one interval of each level, known
by a shift, so finding its range is a join on equality of level and interval. Narrow and wide
ranges are alike: neither copies the other into buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .positions import sorted_blocks

# Codes and bounds are below 2 ** 61 in size, so that sums of bounds and interval lengths fit.
_LIMIT = 1 << 61
# Levels that one round of probes looks through. No interval of a round is sought by more than
# 2 ** 13 keys, so coarse intervals, which all codes share, are no hot keys.
_BAND = 13


def _whole(column: str, what: str) -> Column:
    value = F.col(f"`{column}`").cast("long")
    bad = F.raise_error(F.concat(F.lit(f"{what} out of range: "), value.cast("string"))).cast("long")
    return F.when(value.isNull() | ((value > -_LIMIT) & (value < _LIMIT)), value).otherwise(bad)


def dyadic_intervals(low: str, high: str) -> Column:
    """The intervals that make up an inclusive range, as an array of (level, node).

    An interval holds the numbers whose arithmetic shift by ``level`` is ``node``. The columns hold
    whole numbers below ``2 ** 61`` in size, the lower one first.
    """
    # At each level: the first whole interval that starts in the range, and the first behind it.
    first = f"shiftright({low} + shiftleft(1L, l) - 1L, l)"
    after = f"shiftright({high} + 1L, l)"
    return F.expr(
        f"""flatten(transform(
              transform(sequence(0, length(bin({high} - {low} + 1L)) - 1),
                        l -> named_struct('l', l, 'a', {first}, 'b', {after})),
              s -> filter(array(
                     named_struct('level', s.l, 'node', s.a, 'own', s.a < s.b AND s.a & 1L = 1L),
                     named_struct('level', s.l, 'node', s.b - 1L,
                                  'own', s.b & 1L = 1L AND s.a + (s.a & 1L) < s.b)),
                   i -> i.own)))"""
    )


def overlapping(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Ranges that overlap the one before them in order of their lower bound; empty if none overlap.

    Any overlap shows between neighbours in that order. They are compared inside blocks of it and,
    by one row for each block, across them.
    """
    bounds = ranges.select(F.col(f"`{low}`").alias("low"), F.col(f"`{high}`").alias("high"))
    blocks = sorted_blocks(bounds, ["low", "high"])
    before = F.lag("high").over(Window.partitionBy("__block").orderBy("__row"))
    inside = blocks.withColumn("before", before).select("low", "high", "before")
    ends = blocks.groupBy("__block").agg(
        F.min(F.struct("low", "high")).alias("first"), F.max("high").alias("last")
    )
    earlier = F.lag("last").over(Window.orderBy("__block"))
    across = ends.withColumn("before", earlier).select("first.low", "first.high", "before")
    return inside.unionByName(across).filter(F.col("low") <= F.col("before"))


def _resolved(keys: DataFrame, nodes: DataFrame, levels: Sequence[int], shift: int) -> DataFrame:
    """The range of each key among intervals of some levels; keys are codes shifted by ``shift``."""
    probes = keys.select("key", F.explode(F.array(*(F.lit(v) for v in levels))).alias("level"))
    probes = probes.withColumn("node", F.expr(f"shiftright(key, level - {shift})"))
    return probes.join(nodes, ["level", "node"]).select("key", "found")


def lookup_ranges(
    df: DataFrame, column: str, ranges: DataFrame, low: str = "low", high: str = "high"
) -> DataFrame:
    """Adds what a table of ranges says of the range that each code falls in, NULL for no range.

    ``ranges`` has inclusive whole bounds and any further columns, which are added to ``df``; their
    names must be new. Several ranges may say the same. Overlapping, empty and missing bounds
    are errors, and so are bounds and codes of 2 ** 61 or more. A missing code has no range.

    Each distinct code is sought once, in at most 62 probes, each a join on equality; codes that share
    an interval of more than 8,192 numbers seek it together. What was found joins the rows on the code,
    where Spark broadcasts a small side and splits hot codes of a large one. The call runs the jobs
    that check the ranges and collect the codes; the result is lazy.
    """
    added = [c for c in ranges.columns if c not in (low, high)]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    missing = F.raise_error(F.lit(f"a range without {low} or {high}")).cast("long")
    empty = F.raise_error(
        F.concat_ws(" ", F.lit("empty range"), F.col(f"`{low}`").cast("string"), F.col(f"`{high}`").cast("string"))
    ).cast("long")
    first, last = _whole(low, low), _whole(high, high)
    checked = F.when(first.isNull() | last.isNull(), missing).when(first > last, empty).otherwise(first)
    table = materialise(
        ranges.select(
            checked.alias("low"),
            last.alias("high"),
            F.struct(F.lit(True).alias("__known"), *(F.col(f"`{c}`") for c in added)).alias("found"),
        ),
        "ranges",
    )
    clash = overlapping(table, "low", "high").first()
    if clash:
        raise ValueError(f"the range {clash.low}-{clash.high} overlaps one that ends at {clash.before}")
    nodes = table.select(F.explode(dyadic_intervals("low", "high")).alias("i"), "found")
    nodes = materialise(nodes.select("i.level", "i.node", "found"), "range-intervals")
    levels = sorted(row.level for row in nodes.select("level").distinct().collect())
    top = max(levels, default=0) // _BAND
    code = _whole(column, column)
    keys = df.select(code.alias("key")).filter(F.col("key").isNotNull()).distinct()
    bands = [materialise(keys, "range-codes")]
    for _ in range(top):
        coarser = bands[-1].select(F.shiftright("key", _BAND).alias("key")).distinct()
        bands.append(materialise(coarser, "range-codes"))
    known = None
    for band in reversed(range(top + 1)):
        shift = band * _BAND
        own_levels = [v for v in levels if shift <= v < shift + _BAND]
        own = nodes.filter(F.col("level").isin(own_levels))
        found = bands[band].join(_resolved(bands[band], own, own_levels or [shift], shift), "key", "left")
        if known is not None:
            # A key has what the key above it has: 8,192 keys at most share one.
            above = known.select(F.col("key").alias("above"), F.col("found").alias("inherited"))
            found = found.join(above, F.shiftright("key", _BAND) == F.col("above"), "left").select(
                "key", F.coalesce("found", "inherited").alias("found")
            )
        known = materialise(found.filter(F.col("found").isNotNull()), "range-found")
    by_code = known.select(F.col("key").alias("__code"), F.col("found").alias("__found"))
    return df.join(by_code, F.col(f"`{column}`").cast("long") == F.col("__code"), "left").select(
        *(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__found.`{c}`").alias(c) for c in added)
    )
