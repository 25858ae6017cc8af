"""Values as text, and small helpers for texts, bits, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.atomic import INTS
from tessera.functions.encode import INT_INF, INT_NEG_INF, INT_NULL


def escaped(c: Column) -> Column:
    """A text with backslashes, quotes and control characters escaped as in JSON."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(3), F.length(inside) - 4)


def rendered(c: Column, kind: T.DataType) -> Column:
    """How the console shows a value: lists in brackets, texts in quotes, a float with
    a decimal, spans with the letter of their unit."""
    if isinstance(kind, T.ArrayType):
        own = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: rendered(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        own = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(rendered(e["key"], kind.keyType), F.lit(": "), rendered(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        own = F.concat(F.lit('"'), escaped(c), F.lit('"'))
    elif isinstance(kind, INTS):
        own = F.when(c == INT_NULL, "NAN").when(c == INT_INF, "∞").when(c == INT_NEG_INF, "-∞").otherwise(c.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = c.cast("string")
        own = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(plain.rlike("[.E]"), plain).otherwise(F.concat(plain, F.lit(".0")))
    elif isinstance(kind, T.YearMonthIntervalType):
        months = F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)
        own = F.when(months % 12 == 0, F.concat((months / 12).cast("long").cast("string"), F.lit("y"))).otherwise(F.concat(months.cast("string"), F.lit("m")))
    else:
        own = c.cast("string")
    return F.coalesce(own, F.lit("null"))


def raw(c: Column, kind: T.DataType) -> Column:
    """A text as it is; any other value as it is shown."""
    return c if isinstance(kind, T.StringType) else rendered(c, kind)


# ------------------------------------------------------------------------- bits


def floor_log2(c: Column) -> Column:
    """Of a positive integer; null of others."""
    return F.when(c > 0, F.length(F.bin(c)) - 1)


def ceil_log2(c: Column) -> Column:
    return F.when(c > 0, F.when(c == 1, 0).otherwise(F.length(F.bin(c - 1))))


def is_power_of_two(c: Column) -> Column:
    return (c > 0) & (F.bit_count(c) == 1)


def round_up_power(c: Column) -> Column:
    """The smallest power of two that is no smaller."""
    return F.when(c > 0, F.call_function("shiftleft", F.lit(1).cast("long"), ceil_log2(c)))


def bit(c: Column, i: int) -> Column:
    return F.getbit(c.cast("long"), F.lit(i)).cast("int")


def bit_set(c: Column, i: int) -> Column:
    return c.cast("long").bitwiseOR(F.lit(1 << i))


def bit_clear(c: Column, i: int) -> Column:
    return c.cast("long").bitwiseAND(F.lit(~(1 << i)))


def bit_flip(c: Column, i: int) -> Column:
    return c.cast("long").bitwiseXOR(F.lit(1 << i))


# ------------------------------------------------------------------------ dates

#: Nanoseconds of a unit of time of day.
UNIT_NANOS = {"h": 3_600_000_000_000, "i": 60_000_000_000, "s": 1_000_000_000, "t": 1_000_000, "u": 1_000, "n": 1}


def years(n: Column | int) -> Column:
    """A span of n years."""
    return F.make_ym_interval(F.lit(n) if isinstance(n, int) else n, F.lit(0))


def year_stamp(n: Column | int) -> Column:
    """The first day of year n."""
    return F.make_date(F.lit(n) if isinstance(n, int) else n, F.lit(1), F.lit(1))


def rescaled(c: Column, unit: str, into: str) -> Column:
    """A whole number of one unit of time of day in another, rounded down."""
    return F.floor(c.cast("decimal(38,0)") * UNIT_NANOS[unit] / UNIT_NANOS[into]).cast("long")


def day_spans(n: Column) -> Column:
    return F.make_dt_interval(n)
