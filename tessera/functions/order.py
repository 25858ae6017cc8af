"""The engine's total order, equality, truth and hashes, as expressions.

Order: null, then NaN, then numbers by value; of sequences (texts too) the shorter
is smaller, and equally long ones compare item by item; maps compare by their
entries in key order.  NaN equals NaN and null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.atomic import INTS, NUMBERS
from tessera.functions.encode import INT_NULL

FLOATS = (T.FloatType, T.DoubleType)


def sort_key(c: Column, kind: T.DataType) -> Column:
    """An expression that Spark sorts as the engine sorts c."""
    there = c.isNotNull().alias("there")
    if isinstance(kind, FLOATS):
        value = c.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one number
        return F.struct(there, (~F.isnan(c)).alias("number"), value.alias("value"))
    if isinstance(kind, NUMBERS):
        return F.struct(there, c.alias("value"))
    if isinstance(kind, T.StringType):
        return F.struct(there, F.char_length(c).alias("size"), c.alias("value"))
    if isinstance(kind, T.ArrayType):
        return F.struct(there, F.when(c.isNotNull(), F.size(c)).alias("size"), F.transform(c, lambda x: sort_key(x, kind.elementType)).alias("items"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(sort_key(e["key"], kind.keyType).alias("k"), sort_key(e["value"], kind.valueType).alias("v")))
        return F.struct(there, F.when(c.isNotNull(), F.size(c)).alias("size"), F.array_sort(entries).alias("items"))
    if isinstance(kind, T.StructType):
        return F.struct(there, *[sort_key(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.struct(there, c.alias("value"))


def ordered_by(df: DataFrame, *names: str, descending: bool = False) -> DataFrame:
    """df in the engine's order of the named columns."""
    keys = [sort_key(F.col(n), df.schema[n].dataType) for n in names]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def compare(a: Column, b: Column, kind: T.DataType) -> Column:
    """-1, 0 or 1: a smaller than, equal to, or larger than b."""
    x, y = sort_key(a, kind), sort_key(b, kind)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def match(a: Column, b: Column, kind: T.DataType) -> Column:
    """Deep equality of whole values; never null."""
    return sort_key(a, kind).eqNullSafe(sort_key(b, kind))


def grade(a: Column, kind: T.DataType, descending: bool = False) -> Column:
    """The positions that sort a vector cell; ties keep their order."""
    place = lambda x, i: F.struct(sort_key(x, kind).alias("k"), (-i if descending else i).alias("i"))
    up = F.sort_array(F.transform(a, place), asc=not descending)
    return F.transform(up, lambda e: F.abs(e["i"]))


def sort_cell(a: Column, kind: T.DataType, descending: bool = False) -> Column:
    return F.transform(grade(a, kind, descending), lambda i: F.get(a, i))


def truthy(c: Column, kind: T.DataType) -> Column:
    """False of 0, the NUL character and null; true of all else, empty values too."""
    if isinstance(kind, NUMBERS):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != F.lit("\0"), F.lit(False))
    return c.isNotNull()


def nullish(c: Column, kind: T.DataType) -> Column:
    """True of null, NaN, the integer that stands for null, and the NUL character."""
    if isinstance(kind, FLOATS):
        return c.isNull() | F.coalesce(F.isnan(c), F.lit(False))
    if isinstance(kind, INTS):
        return c.isNull() | F.coalesce(c.cast("long") == INT_NULL, F.lit(False))
    if isinstance(kind, T.StringType):
        return c.isNull() | F.coalesce(c == F.lit("\0"), F.lit(False))
    return c.isNull()


def value_hash(c: Column, kind: T.DataType) -> Column:
    """64 bits; equal values have equal hashes, an integer and its double too; of a
    map, the order of entries doesn't count."""
    if isinstance(kind, NUMBERS):
        x = c.cast("double") + F.lit(0.0)
        return F.xxhash64(F.when(x.isNull() | F.isnan(x), F.lit(float("nan"))).otherwise(x))
    if isinstance(kind, T.ArrayType):
        return F.aggregate(c, F.lit(42).cast("long"), lambda h, x: F.xxhash64(h, value_hash(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        own = lambda e: F.xxhash64(value_hash(e["key"], kind.keyType), value_hash(e["value"], kind.valueType))
        return F.aggregate(F.map_entries(c), F.lit(7).cast("long"), lambda h, e: h.bitwiseXOR(own(e)))
    return F.xxhash64(c)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType)


def is_unit(kind: T.DataType) -> bool:
    """No vector, map or struct."""
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def is_nil(c: Column) -> Column:
    return c.isNull()
