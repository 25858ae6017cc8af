"""Changes of tables as new tables: insert, update, upsert, delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InsertValuesError


def rows_like(table: DataFrame, rows: Sequence[Sequence]) -> DataFrame:
    """Literal rows with the columns and types of a table."""
    width = len(table.columns)
    for r in rows:
        if len(r) != width:
            raise InsertValuesError(f"a row of {len(r)} values for {width} columns")
    spark = table.sparkSession
    if not rows:
        return table.limit(0)
    literals = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name) for v, f in zip(r, table.schema.fields, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*literals)))


def insert(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the rows of another one after it, matched by position."""
    if len(new.columns) != len(table.columns):
        raise InsertValuesError(f"{len(new.columns)} columns for {len(table.columns)}")
    same = new.toDF(*table.columns)
    return table.unionAll(same.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields]))


def update(table: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Columns changed where the predicate holds; all changes see the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, changes[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema.fields])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Without the rows for which the predicate holds; without one, no row is left."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, new: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """New rows replace those with equal keys, and are added otherwise.  The key is the
    first column unless ``on`` names others; null keys are equal.  Of new rows with
    one key, one stays."""
    keys = list(on) or [table.columns[0]]
    fresh = insert(table.limit(0), new).dropDuplicates(keys)
    marked = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = None
    for k in keys:
        part = table[k].eqNullSafe(marked[f"__{k}"])
        same = part if same is None else same & part
    return table.join(marked, same, "left_anti").unionAll(fresh)
