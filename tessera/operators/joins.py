"""Joins that Spark has no operator for, and joins of skewed keys.

Equality, semi, anti and outer joins are ``DataFrame.join``: Spark broadcasts a side
only below the session's size threshold and splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, at: str, by: Sequence[str], columns: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the columns of the last row of right, in its group, whose ``at`` is not
    later (earlier if strict).  One union, one sort per group, no pairs.

    Of several right rows with one ``at`` the largest in order of ``columns`` counts.
    A group much larger than a task's memory spills; split it by ``asof_bucketed``.
    """
    rows = left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns], F.lit(1).alias("__side"))
    facts = right.select(*by, at, *[F.col(c).alias(f"__{c}") for c in columns])
    facts = facts.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *[f"__{c}" for c in columns], F.lit(2 if strict else 0).alias("__side"))
    fact = F.when(F.col("__side") != 1, F.struct(*[f"__{c}" for c in columns]))
    w = Window.partitionBy(*by).orderBy(at, "__side", *[f"__{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(facts).withColumn("__fact", F.last(fact, ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*left.columns, *[F.col("__fact")[f"__{c}"].alias(c) for c in columns])


def asof_bucketed(left: DataFrame, right: DataFrame, at: str, by: Sequence[str], columns: Sequence[str], seconds: int) -> DataFrame:
    """``asof`` for groups that one task can't hold: time is cut in buckets, which are
    joined on their own; what a bucket inherits from earlier ones is one row a bucket."""
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    lefts, rights = left.withColumn("__b", bucket), right.withColumn("__b", bucket)
    near = asof(lefts, rights, at, [*by, "__b"], columns)
    ends = rights.groupBy(*by, "__b").agg(F.max(F.struct(at, *columns)).alias("__last"))
    wanted = lefts.select(*by, "__b").distinct().unionByName(ends.select(*by, "__b")).distinct()
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.join(ends, [*by, "__b"], "left").withColumn("__carried", F.last("__last", ignorenulls=True).over(w)).select(*by, "__b", "__carried")
    none = None
    for c in columns:
        none = F.col(c).isNull() if none is None else none & F.col(c).isNull()
    both = near.join(carried, [*by, "__b"], "left")
    return both.select(*left.columns, *[F.when(none, F.col("__carried")[c]).otherwise(F.col(c)).alias(c) for c in columns])


def within(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of left with each row of right whose [start, end) holds left's point.

    Values are whole numbers.  Intervals are entered in each cell of ``width`` that
    they touch, so rows meet by an equality join on the cell; a width about as large
    as a usual interval keeps both copies and misses few.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spans = right.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(cell(start), F.floor((F.col(end) - 1) / width).cast("long"))))
    return left.withColumn("__cell", cell(point)).join(spans, ["__cell", *by]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__cell")


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, hot: Column) -> DataFrame:
    """An inner equality join whose hot keys (``hot`` is an expression on the key
    columns) are dealt over ``salts`` partitions; right rows of hot keys are copied."""
    many = F.when(hot, F.lit(salts)).otherwise(F.lit(1))
    spread = left.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), many - 1)))
    return spread.join(copies, [*on, "__salt"]).drop("__salt")


def all_pairs(left: DataFrame, right: DataFrame, most_rows: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Every row of left with every row of right.  One side must be small, as its
    count and the bytes of its rows show; it is broadcast."""

    def small(df: DataFrame) -> bool:
        some = df.limit(most_rows + 1)
        got = some.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
        return got.n <= most_rows and (got.b or 0) <= most_bytes

    if small(right):
        return left.crossJoin(F.broadcast(right))
    if small(left):
        return F.broadcast(left).crossJoin(right)
    raise ValueError(f"both sides have more than {most_rows} rows or {most_bytes} bytes")
