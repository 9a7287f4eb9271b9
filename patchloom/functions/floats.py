"""Floating point numbers as their IEEE 754 bits, by arithmetic on columns: every step is exact."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packets import let


class Layout(NamedTuple):
    size: int
    mantissa: int
    bias: int

    @property
    def least(self) -> int:
        """The exponent of the least normal number."""
        return 1 - self.bias


SINGLE, DOUBLE = Layout(4, 23, 127), Layout(8, 52, 1023)


def layout_of(kind: T.DataType) -> Layout:
    return SINGLE if isinstance(kind, T.FloatType) else DOUBLE


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def bits(value: Column, layout: Layout = DOUBLE) -> Column:
    """The bits as a long; a NaN is the quiet one."""
    size, mantissa, bias = layout
    shift = lambda n, by: F.shiftleft(n.cast("long"), by)
    full = F.lit(((2 * bias + 1) << mantissa)).cast("long")

    def of(x: Column) -> Column:
        a = F.abs(x)
        # The logarithm may be one off where a power of two is near; the quotient tells.
        guess = F.greatest(F.lit(layout.least), F.least(F.lit(bias), F.floor(F.log2(a)).cast("int")))
        right = lambda g: F.when(a / _power(g) >= 2, g + 1).when((a / _power(g) < 1) & (g > layout.least), g - 1).otherwise(g)
        normal = lambda e: shift(e + bias, mantissa) + ((a / _power(e) - 1) * 2.0**mantissa).cast("long")
        half = (mantissa - layout.least) // 2  # the whole power is beyond a double
        small = a * 2.0**half * 2.0 ** (mantissa - layout.least - half)
        body = F.when(F.isnan(x), full + (1 << (mantissa - 1))).when(a == float("inf"), full).when(a < 2.0**layout.least, small.cast("long")).otherwise(let(let(guess, right), normal))
        return F.when(x.cast("string").startswith("-"), body.bitwiseOR(shift(F.lit(1), 8 * size - 1))).otherwise(body)

    return let(value.cast("double"), of)


def from_bits(raw: Column, layout: Layout = DOUBLE) -> Column:
    """The double that the bits stand for."""
    size, mantissa, bias = layout

    def of(b: Column) -> Column:
        e = F.shiftright(b, mantissa).bitwiseAND(F.lit(2 * bias + 1))
        m = b.bitwiseAND(F.lit((1 << mantissa) - 1)).cast("double")
        special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        value = F.when(e == 2 * bias + 1, special).when(e == 0, m * 2.0 ** (layout.least - mantissa)).otherwise((1 + m / 2.0**mantissa) * _power(e - bias))
        negative = F.shiftright(b, 8 * size - 1).bitwiseAND(F.lit(1)) == 1
        return F.when(negative, -value).otherwise(value)

    return let(raw.cast("long"), of)
