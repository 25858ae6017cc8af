"""Sentinels, casts, and the widths that numbers need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how 64-bit integers stand for null and the infinities
INT_NULL = -(2**63)
INT_INF = 2**63 - 1
INT_NEG_INF = -(2**63 - 1)


def from_sentinel(c: Column) -> Column:
    """A stored integer, with the one that stands for null read as null."""
    return F.when(c != INT_NULL, c)


def to_float(c: Column) -> Column:
    """An integer as a double: the null sentinel as NaN, the infinite ones as infinities."""
    return F.when(c == INT_NULL, F.lit(float("nan"))).when(c == INT_INF, F.lit(float("inf"))).when(c == INT_NEG_INF, F.lit(float("-inf"))).otherwise(c.cast("double"))


def to_int(c: Column) -> Column:
    """A double cut to an integer: NaN as null, infinities (and what is as large) as
    the infinite integers."""
    big = F.lit(float(2**63))
    return F.when(F.isnan(c), F.lit(None).cast("long")).when(c >= big, F.lit(INT_INF)).when(c <= -big, F.lit(INT_NEG_INF)).otherwise(F.when((c > -big) & (c < big), c).cast("long"))


def to_bool(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def to_char(c: Column) -> Column:
    """The first character of a text; null of an empty one."""
    return F.when(F.length(c) > 0, F.substring(c, 1, 1))


def int_width(c: Column) -> Column:
    """Bytes (1, 2, 4 or 8) that an integer needs.  Each width keeps its smallest value
    for null and its two outermost ones for the infinities, so 127 takes two bytes;
    null and the infinities themselves fit one."""
    inside = lambda bits: c.between(-(2 ** (bits - 1)) + 2, 2 ** (bits - 1) - 2)
    special = c.isNull() | c.isin(INT_NULL, INT_INF, INT_NEG_INF)
    return F.when(special | inside(8), 1).when(inside(16), 2).when(inside(32), 4).otherwise(8)


def float_width(c: Column) -> Column:
    """Bytes (2, 4 or 8) that hold a double exactly.  A half has 11 significant bits
    and exponents from -14 to 15; null, NaN and the infinities fit it."""
    x = c.cast("double")
    size = F.abs(x)
    special = x.isNull() | F.isnan(x) | (size == float("inf")) | (size == 0)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14))
    steps = size * F.pow(F.lit(2.0), F.lit(10) - exponent)
    half = (size <= 65504) & (steps == F.floor(steps))
    return F.when(special | half, 2).when(x.cast("float").cast("double") == x, 4).otherwise(8)


def clip(c: Column, width: int) -> Column:
    """An integer held in ``width`` bytes: what is too large becomes that width's
    infinity."""
    if width == 8:
        return c
    most = 2 ** (8 * width - 1) - 1
    return F.greatest(F.lit(-most), F.least(F.lit(most), c)).cast("long")
