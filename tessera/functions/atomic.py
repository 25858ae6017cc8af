"""Arithmetic on atoms by a table of kinds, and lifted over nested vectors.

Numbers add, subtract, multiply and negate; spans of one unit add and negate; a
stamp and a span add, in either order.  Every other pair gives null, decided when
the plan is made.  A difference is a sum with the negated right side, so a stamp
minus a stamp is null.  Nulls propagate; integer overflow is an error under ANSI
settings, or wraps around where asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import cells

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTS, T.FloatType, T.DoubleType, T.DecimalType)
SPANS = (T.DayTimeIntervalType, T.YearMonthIntervalType)
STAMPS = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Typed:
    """A column expression and the type it has.  ``bound`` marks expressions on a
    lambda's arguments, which can't be analysed on their own."""

    column: Column
    kind: T.DataType
    bound: bool = False

    def blank(self) -> Typed:
        """A null of the same type."""
        return Typed(F.lit(None).cast(self.kind), self.kind)

    @staticmethod
    def of(df: DataFrame, what: Column | str) -> Typed:
        column = F.col(what) if isinstance(what, str) else what
        return Typed(column, df.select(column).schema[0].dataType)

    @staticmethod
    def literal(spark: SparkSession, column: Column) -> Typed:
        return Typed.of(spark.range(1), column)

    @property
    def depth(self) -> int:
        n, kind = 0, self.kind
        while isinstance(kind, T.ArrayType):
            n, kind = n + 1, kind.elementType
        return n

    @property
    def atom(self) -> T.DataType:
        kind = self.kind
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return kind


def _family(kind: T.DataType) -> str:
    for name, kinds in (("int", INTS), ("float", NUMBERS), ("span", SPANS), ("stamp", STAMPS)):
        if isinstance(kind, kinds):
            return name
    return "other"


def _same_unit(a: T.DataType, b: T.DataType) -> bool:
    return isinstance(a, T.YearMonthIntervalType) == isinstance(b, T.YearMonthIntervalType)


def wrap_long(exact: Column) -> Column:
    """An exact DECIMAL(38, 0) result reduced to 64 bits in two's complement."""
    half, whole = (F.lit(str(2**bits)).cast("decimal(38,0)") for bits in (63, 64))
    return (F.pmod(exact + half, whole) - half).cast("long")


def _sum(a: Column, b: Column, ka: T.DataType, kb: T.DataType, wrap: bool) -> Column | None:
    fa, fb = _family(ka), _family(kb)
    if fa == fb == "int":
        if wrap:
            return wrap_long(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))
        return a.cast("long") + b.cast("long")
    if {fa, fb} <= {"int", "float"}:
        return a.cast("double") + b.cast("double")
    if fa == fb == "span":
        return a + b if _same_unit(ka, kb) else None
    if fa == "stamp" and fb == "span":
        return a + b
    if fa == "span" and fb == "stamp":
        return b + a
    return None


def _product(a: Column, b: Column, ka: T.DataType, kb: T.DataType, wrap: bool) -> Column | None:
    fa, fb = _family(ka), _family(kb)
    if fa == fb == "int":
        if wrap:
            return wrap_long(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))
        return a.cast("long") * b.cast("long")
    if {fa, fb} <= {"int", "float"}:
        return a.cast("double") * b.cast("double")
    return None


def _negated(a: Column, kind: T.DataType, wrap: bool) -> Column | None:
    family = _family(kind)
    if family == "int":
        return wrap_long(-a.cast("decimal(20,0)")) if wrap else -a.cast("long")
    if family in ("float", "span"):
        return -a
    return None


def _apply2(rule, left: Typed, right: Typed, wrap: bool) -> Column:
    if rule(F.lit(None), F.lit(None), left.atom, right.atom, wrap) is None:
        return _null(max(left.depth, right.depth), left if left.depth >= right.depth else right)
    return cells.lifted2(lambda a, b: rule(a, b, left.atom, right.atom, wrap), left.column, right.column, left.depth, right.depth)


def _null(depth: int, shape: Typed) -> Column:
    return cells.lifted(lambda _: F.lit(None).cast("long"), shape.column, depth)


def add(left: Typed, right: Typed, wrap: bool = False) -> Column:
    return _apply2(_sum, left, right, wrap)


def multiply(left: Typed, right: Typed, wrap: bool = False) -> Column:
    return _apply2(_product, left, right, wrap)


def negate(value: Typed, wrap: bool = False) -> Column:
    if _negated(F.lit(None), value.atom, wrap) is None:
        return _null(value.depth, value)
    return cells.lifted(lambda a: _negated(a, value.atom, wrap), value.column, value.depth)


def subtract(left: Typed, right: Typed, wrap: bool = False) -> Column:
    def rule(a, b, ka, kb, wraps):
        if _family(ka) == _family(kb) == "int" and wraps:
            return wrap_long(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"))
        minus = _negated(b, kb, False)
        return None if minus is None else _sum(a, minus, ka, T.LongType() if _family(kb) == "int" else kb, False)

    return _apply2(rule, left, right, wrap)


# ----------------------------------------------------------- further number verbs


def divide(a: Column, b: Column) -> Column:
    """A quotient as a double; by zero it is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder that has the divisor's sign; by zero it is null."""
    return F.when(b != 0, F.pmod(a, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))
