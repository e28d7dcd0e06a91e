"""Sums of doubles that do not depend on the order of adding.

Every finite double is a whole number times a power of two. Cut into digits of 16 bits on a grid that
all values share, it becomes a few whole numbers (limbs), and sums of whole numbers are exact in any
order: partial sums, merges and prefix sums all give the same limbs. Only the final limbs are turned
into a double, rounded once, to the nearest. Columns only: no Python runs for a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a digit. A limb adds up 2 ** 47 of them before it leaves 64 bits.
BITS = 16
_BASE = 1 << BITS
# Digits that carries out of the highest limb may need.
_CARRY_DIGITS = 4
# Zero bytes below the lowest digit, so that there are always enough to round.
_PADDING = 8


@dataclass(frozen=True)
class Grid:
    """Digits from ``2 ** (16 * low)`` on, ``n`` of them."""

    low: int
    n: int

    @classmethod
    def covering(cls, least: float | None, greatest: float | None) -> Grid:
        """The grid of all doubles between two absolute values, the least one not zero."""
        if not least or not greatest:
            return cls(0, 1)
        # A double has 53 bits, and none below 2 ** -1074.
        lowest_bit = max(math.frexp(least)[1] - 53, -1074)
        low = lowest_bit // BITS
        return cls(low, (math.frexp(greatest)[1] - 1) // BITS - low + 1)

    def exponent(self, i: int) -> int:
        return BITS * (self.low + i)


def is_finite(value: Column) -> Column:
    """True for a number that is neither missing, NaN nor infinite."""
    return F.coalesce(F.abs(value) < math.inf, F.lit(False))


def _scaled(value: Column, exponent: int) -> Column:
    """``value * 2 ** exponent``, in two steps where the factor is no double."""
    if abs(exponent) <= 1_000:
        return value * F.lit(math.ldexp(1.0, exponent))
    half = exponent // 2
    return value * F.lit(math.ldexp(1.0, half)) * F.lit(math.ldexp(1.0, exponent - half))


def limbs(value: Column, grid: Grid) -> list[Column]:
    """The digits of a double on a grid, lowest first, with its sign; zeros if it is not finite."""
    size = F.when(is_finite(value), F.abs(value)).otherwise(0.0)
    found = []
    for i in range(grid.n):
        exponent = grid.exponent(i)
        digit = F.floor(_scaled(size, -exponent) % F.lit(float(_BASE)))
        # All bits of a number this large are above the digit.
        above = exponent + BITS + 53
        if above < 1_024:
            digit = F.when(size < math.ldexp(1.0, above), digit).otherwise(0)
        found.append(F.when(value < 0, -digit).otherwise(digit).cast("long"))
    return found


def _digits(sums: Column) -> tuple[Column, ...]:
    """Folds limbs into digits from 0 to 65,535, with what is carried beyond them."""
    start = F.struct(
        F.lit(0).cast("long").alias("carry"),
        F.array().cast("array<bigint>").alias("digits"),
        F.lit(0).cast("long").alias("minus_carry"),
        F.array().cast("array<bigint>").alias("minus_digits"),
    )

    def step(state: Column, limb: Column) -> Column:
        up, down = state["carry"] + limb, state["minus_carry"] - limb
        return F.struct(
            F.shiftright(up, BITS).alias("carry"),
            F.concat(state["digits"], F.array(up.bitwiseAND(_BASE - 1))).alias("digits"),
            F.shiftright(down, BITS).alias("minus_carry"),
            F.concat(state["minus_digits"], F.array(down.bitwiseAND(_BASE - 1))).alias("minus_digits"),
        )

    return start, step


def rounded_once(sums: Sequence[Column], grid: Grid) -> Column:
    """The double nearest to what summed limbs stand for; ties go to the even one."""
    zero = F.lit(0).cast("long")
    whole = F.array(*(F.coalesce(s, zero) for s in sums), *[zero] * _CARRY_DIGITS)
    start, step = _digits(whole)
    n_bytes = 2 * (grid.n + _CARRY_DIGITS) + _PADDING
    # Exponent of the last of the 62 bits that follow when the highest byte is at a place.
    exponents = [grid.exponent(0) - 8 * _PADDING + 8 * (top - 6) - 6 for top in range(n_bytes)]
    halves = F.array(*(F.lit(math.ldexp(1.0, max(-1_074, e // 2))) for e in exponents))
    others = F.array(*(F.lit(math.ldexp(1.0, max(-1_074, e - e // 2))) for e in exponents))

    def from_digits(state: Column) -> Column:
        negative = state["carry"] < 0
        digits = F.when(negative, state["minus_digits"]).otherwise(state["digits"])
        pairs = F.transform(digits, lambda d: F.array(d.bitwiseAND(255), F.shiftright(d, 8)))
        low_first = F.concat(F.array_repeat(zero, _PADDING), F.flatten(pairs))
        begin = F.struct(
            zero.alias("top"), zero.alias("taken"), zero.alias("bits"), zero.alias("rest")
        )

        def take(seen: Column, byte: Column) -> Column:
            """Seven bytes from the highest filled one, six bits of the next, and whether more follow."""
            taken, begun = seen["taken"], (seen["taken"] > 0) | (byte != 0)
            bits = (
                F.when(taken < 7, seen["bits"] * 256 + byte)
                .when(taken == 7, seen["bits"] * 64 + F.shiftright(byte, 2))
                .otherwise(seen["bits"])
            )
            lost = F.when(taken == 7, byte.bitwiseAND(3)).when(taken > 7, byte).otherwise(0)
            return F.struct(
                (seen["top"] + F.when(begun, 0).otherwise(1)).cast("long").alias("top"),
                (taken + F.when(begun, 1).otherwise(0)).cast("long").alias("taken"),
                bits.cast("long").alias("bits"),
                seen["rest"].bitwiseOR(lost.cast("long")).alias("rest"),
            )

        def finish(seen: Column) -> Column:
            # At least 55 bits, the last of them set if anything was left out: rounding is right.
            bits = seen["bits"].bitwiseOR(F.when(seen["rest"] != 0, 1).otherwise(0).cast("long"))
            place = (F.lit(n_bytes) - seen["top"]).cast("int")
            size = bits.cast("double") * F.element_at(halves, place) * F.element_at(others, place)
            return (
                F.when(seen["taken"] == 0, 0.0).when(negative, -size).otherwise(size).cast("double")
            )

        return F.aggregate(F.reverse(low_first), begin, take, finish)

    return F.aggregate(whole, start, step, from_digits)
