"""Tables that are made, not read: progressions, random numbers, literals; and
readers of common formats with the options that matter at scale."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import KindError


def numbers(spark: SparkSession, n: int, base: int = 0, step: int = 1) -> DataFrame:
    """(pos, value): base, base + step, ... of length n; none if n is not positive."""
    return spark.range(max(0, n)).select(F.col("id").alias("pos"), (F.lit(base) + F.col("id") * F.lit(step)).cast("long").alias("value"))


def random_floats(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """(pos, value): uniform in [0, 1)."""
    return spark.range(max(0, n)).select(F.col("id").alias("pos"), (F.rand(seed) if seed is not None else F.rand()).alias("value"))


def random_ints(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, value): 64 bits hashed from the seed and the position; reruns agree."""
    return spark.range(max(0, n)).select(F.col("id").alias("pos"), F.xxhash64("id", F.lit(seed)).alias("value"))


#: Type names of empty vectors.
KINDS = {"char": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "year": T.IntegerType(), "month": T.DateType(), "day": T.DateType(), "hour": T.TimestampNTZType(), "minute": T.TimestampNTZType(), "second": T.TimestampNTZType(), "time": T.LongType(), "months": T.YearMonthIntervalType(), "span": T.DayTimeIntervalType(), "list": T.ArrayType(T.LongType()), "map": T.MapType(T.StringType(), T.LongType()), "bytes": T.BinaryType(), "bool": T.BooleanType(), "mixed": T.VariantType(), "decimal": T.DecimalType(38, 0)}


def empty(spark: SparkSession, kind: str) -> DataFrame:
    """An empty vector (pos, value) of a named type."""
    if kind not in KINDS:
        raise KindError(f"no type {kind}")
    return spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", KINDS[kind])]))


def vector(spark: SparkSession, items: list, kind: str | None = None) -> DataFrame:
    """(pos, value) of Python items; whole numbers and floats together become floats."""
    if not items:
        return empty(spark, kind or "int")
    table = pa.table({"pos": pa.array(range(len(items)), pa.int64()), "value": pa.array([float(x) if any(isinstance(y, float) for y in items) and isinstance(x, int) else x for x in items])})
    return spark.createDataFrame(table)


def buffer(spark: SparkSession, raw: bytes, dtype: str = "<i8") -> DataFrame:
    """(pos, value) of a raw buffer of numbers."""
    import numpy as np

    values = np.frombuffer(raw, dtype)
    return spark.createDataFrame(pa.table({"pos": np.arange(len(values)), "value": values}))


def csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A schema is asked for: inferring one would read the data twice."""
    return spark.read.schema(schema).options(**{"header": "true"} | options).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by ``parts`` connections over ranges of a column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()
