"""Vectors in long form: a table with a position and a value, perhaps many vectors
told apart by group columns.

Positions count from 0 within a group.  Operations inside groups are windows or
group-bys on the group columns.  A single long vector has no group column; its
scans and ordinals run in two passes over range partitions (``ordinals``,
``running``), so no step needs all rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialised

Order = Sequence[str | Column]


# ------------------------------------------------------------- order of one table


def _ranged(df: DataFrame, order: Order, parts: int | None) -> tuple[DataFrame, Window]:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = materialised(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    return kept, Window.partitionBy("__part").orderBy(*order)


def _prefix(per_part: DataFrame, what: Column) -> DataFrame:
    """What comes before each part; one row for each range partition meets here."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select("__part", what.over(before).alias("__before")))


def ordinals(df: DataFrame, order: Order, name: str = "pos", parts: int | None = None) -> DataFrame:
    """df with its place in the order, from 0.  The order must be total."""
    kept, inside = _ranged(df, order, parts)
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    own = kept.withColumn(name, F.row_number().over(inside) - 1)
    return own.join(_prefix(counts, F.sum("__n")), "__part").withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long")).drop("__part", "__before")


#: For each scan: how values and part totals combine.
_SCANS: dict[str, tuple[Callable, Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, order: Order, value: str, how: str, name: str, parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with the running sum, count, min or max of a column over the whole table, or
    over each group of ``by``.  A group, however large, is cut into range partitions;
    only groups that are cut have totals to carry, at most two rows a partition."""
    agg, both = _SCANS[how]
    total = F.sum if how == "count" else agg
    kept, _ = _ranged(df, [*by, *order], parts)
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = kept.groupBy("__part", *by).agg(agg(value).alias("__n"))
    if by:
        totals = totals.withColumn("__cut", F.count("*").over(Window.partitionBy(*by))).where("__cut > 1")
        before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], total("__n").over(before).alias("__before"))
        own = kept.withColumn(name, agg(value).over(inside))
        same = own["__part"] == carried["__p"]
        for i, c in enumerate(by):
            same = same & own[c].eqNullSafe(carried[f"__{i}"])
        own = own.join(F.broadcast(carried), same, "left").drop("__p", *[f"__{i}" for i in range(len(by))])
    else:
        own = kept.withColumn(name, agg(value).over(inside)).join(_prefix(totals, total("__n")), "__part")
    joined = F.when(F.col("__before").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("__before")).otherwise(both(F.col("__before"), F.col(name)))
    return own.withColumn(name, joined).drop("__part", "__before")


# -------------------------------------------------------------------- the vectors


@dataclass(frozen=True)
class Vec:
    """``df`` has the columns of ``by``, ``pos`` and ``value``."""

    df: DataFrame
    by: tuple[str, ...] = ()

    @staticmethod
    def of(df: DataFrame, value: str | Column, order: Order, by: Sequence[str] = ()) -> Vec:
        """A vector (for each group) of a table's column, in an order that must be total."""
        v = F.col(value) if isinstance(value, str) else value
        if not by:
            if all(isinstance(o, str) for o in order):  # nothing else is sorted and written
                df, order = df.select(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], v.alias("value")), [f"__o{i}" for i in range(len(order))]
            else:
                df = df.withColumn("value", v)
            return Vec(ordinals(df, order).select("pos", "value"))
        pos = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")
        return Vec(df.select(*by, pos.alias("pos"), v.alias("value")), tuple(by))

    @staticmethod
    def range(spark, n: int, base: int = 0, step: int = 1) -> Vec:
        """base, base + step, ... of length n; empty if n is not positive."""
        return Vec(spark.range(max(0, n)).select(F.col("id").alias("pos"), (F.lit(base) + F.col("id") * F.lit(step)).alias("value")))

    def _with(self, df: DataFrame) -> Vec:
        return Vec(df.select(*self.by, "pos", "value"), self.by)

    def _window(self):
        """All rows of a group in order.  Without groups the two-pass forms are used."""
        return Window.partitionBy(*self.by).orderBy("pos")

    # --- atoms of it

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.count("*").alias("value"))

    def item(self, i: int) -> DataFrame:
        return self.df.where(F.col("pos") == i)

    def last(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.max_by("value", "pos").alias("value"))

    def gather(self, at: Vec) -> Vec:
        """Items at the positions that another vector holds, in its shape; out of
        range is null."""
        mine = self.df.select(*self.by, F.col("pos").alias("__at"), F.col("value").alias("__v"))
        found = at.df.withColumn("__at", F.col("value").cast("long")).join(mine, ["__at", *self.by], "left")
        return at._with(found.withColumn("value", F.col("__v")))

    def find(self, what: Column) -> DataFrame:
        """The first position of an item, or the length."""
        hit = F.min(F.when(F.col("value").eqNullSafe(what), F.col("pos")))
        return self.df.groupBy(*self.by).agg(F.coalesce(hit, F.count("*")).alias("value"))

    # --- changes

    def append(self, value: Column) -> Vec:
        end = self.df.groupBy(*self.by).agg((F.max("pos") + 1).alias("pos"))
        return self._with(self.df.unionByName(end.select(*self.by, F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), value.alias("value"))))

    def join(self, other: Vec) -> Vec:
        """The items of the other one after this one's."""
        sizes = self.df.groupBy(*self.by).agg(F.count("*").alias("__n"))
        if self.by:
            moved = other.df.join(sizes, list(self.by), "left")
        else:
            moved = other.df.crossJoin(F.broadcast(sizes))  # one row
        moved = moved.withColumn("pos", (F.col("pos") + F.coalesce("__n", F.lit(0))).cast("long"))
        return self._with(self.df.unionByName(moved.select(*self.by, "pos", "value")))

    def amend(self, i: int, value: Column) -> Vec:
        return self._with(self.df.withColumn("value", F.when(F.col("pos") == i, value).otherwise(F.col("value"))))

    def delete(self, i: int) -> Vec:
        """Positions behind the deleted one move up: no sort is needed."""
        return self._with(self.df.where(F.col("pos") != i).withColumn("pos", F.when(F.col("pos") > i, F.col("pos") - 1).otherwise(F.col("pos"))))

    # --- iteration

    def each(self, f: Callable[[Column], Column]) -> Vec:
        return self._with(self.df.withColumn("value", f(F.col("value"))))

    def zip(self, other: Vec, f: Callable[[Column, Column], Column]) -> Vec:
        """f of the items side by side, by position; unequal lengths are an error."""
        theirs = other.df.select(*self.by, "pos", F.col("value").alias("__w"), F.lit(1).alias("__right"))
        mine = self.df.withColumn("__left", F.lit(1))
        both = mine.join(theirs, [*self.by, "pos"], "full")
        bad = F.col("__left").isNull() | F.col("__right").isNull()
        value = F.when(bad, F.raise_error(F.lit("length does not conform"))).otherwise(f(F.col("value"), F.col("__w")))
        return self._with(both.withColumn("value", value))

    def fold(self, how: Callable[[Column], Column]) -> DataFrame:
        """An associative fold as an aggregate, with partial sums before the shuffle."""
        return self.df.groupBy(*self.by).agg(how(F.col("value")).alias("value"))

    def fold_by(self, f: Callable[[Column, Column], Column], seed: Column | None = None) -> DataFrame:
        """Any fold, in order.  The vectors must fit a cell each."""
        from tessera.functions import cells

        return self.cells().select(*self.by, cells.fold(F.col("value"), f, seed).alias("value"))

    def unfold(self, how: str, seed: Column | None = None, split: bool = False) -> Vec:
        """The running sum, count, min or max; with a seed it comes first, and takes part.
        ``split`` is for groups that one task can't hold."""
        if not self.by:
            rows = self.df if seed is None else self.df.withColumn("pos", F.col("pos") + 1).unionByName(self.df.sparkSession.range(1).select(F.col("id").alias("pos"), seed.alias("value")))
            return self._with(running(rows, ["pos"], "value", how, "__s").withColumn("value", F.col("__s")))
        rows = self.df
        if seed is not None:
            heads = rows.select(*self.by).distinct().select(*self.by, F.lit(0).cast("long").alias("pos"), seed.alias("value"))
            rows = rows.withColumn("pos", F.col("pos") + 1).unionByName(heads)
        if split:
            return self._with(running(rows, ["pos"], "value", how, "__s", by=self.by).withColumn("value", F.col("__s")))
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        return self._with(rows.withColumn("value", _SCANS[how][0]("value").over(w)))

    def mapback(self, f: Callable[[Column, Column], Column], seed: Column | None = None, split: bool = False) -> Vec:
        """f(item, the item before); the first stands, or meets the seed.  ``split`` is
        for groups that one task can't hold (their columns must not be null)."""
        if self.by and not split:
            rows = self.df.withColumn("__before", F.lag("value").over(self._window()))
        else:  # a join by position deals any group over all tasks
            rows = self.df.join(self.df.select(*self.by, (F.col("pos") + 1).alias("pos"), F.col("value").alias("__before")), [*self.by, "pos"], "left")
        first = F.col("value") if seed is None else f(F.col("value"), seed)
        return self._with(rows.withColumn("value", F.when(F.col("pos") == 0, first).otherwise(f(F.col("value"), F.col("__before")))))

    def mapcores(self, f: Callable[[Column], Column], parts: int | None = None) -> Vec:
        """f of each item over contiguous segments in parallel."""
        n = parts or self.df.sparkSession.sparkContext.defaultParallelism
        return self._with(self.df.repartitionByRange(n, *self.by, "pos").withColumn("value", f(F.col("value"))))

    def map_segments(self, f, schema: str, parts: int | None = None) -> DataFrame:
        """An opaque Python function over Arrow batches of segments."""
        n = parts or self.df.sparkSession.sparkContext.defaultParallelism
        return self.df.repartitionByRange(n, *self.by, "pos").mapInArrow(f, schema)

    # --- sets and dictionaries

    def distinct(self) -> Vec:
        """Items in the order they first appear; only distinct ones are ranked."""
        first = self.df.groupBy(*self.by, "value").agg(F.min("pos").alias("pos"))
        if not self.by:
            return self._with(ordinals(first, ["pos"], "__p").withColumn("pos", F.col("__p")))
        return self._with(first.withColumn("pos", (F.row_number().over(self._window()) - 1).cast("long")))

    def encode(self) -> tuple[Vec, Vec]:
        """(dictionary, codes)."""
        words = self.distinct()
        codes = words.df.select(*self.by, F.col("pos").alias("__code"), F.col("value").alias("__word"))
        mine = self.df
        on = mine["value"].eqNullSafe(codes["__word"])
        for c in self.by:
            on = on & mine[c].eqNullSafe(codes[c])
        coded = mine.join(codes, on)
        return words, Vec(coded.select(*[mine[c] for c in self.by], mine["pos"], F.col("__code").alias("value")), self.by)

    # --- other forms

    def cells(self) -> DataFrame:
        """One row for each group, with its vector as an ARRAY; for short vectors."""
        packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
        return self.df.groupBy(*self.by).agg(F.transform(packed, lambda e: e["value"]).alias("value"))

    @staticmethod
    def from_cells(df: DataFrame, column: str, by: Sequence[str]) -> Vec:
        """The long form of an ARRAY column."""
        return Vec(df.select(*by, F.posexplode(column).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), tuple(by))


@dataclass(frozen=True)
class Ordered:
    """A table's column in the order of some of its columns, which must be total.  What
    needs one item or one place is found without giving every row its place."""

    df: DataFrame
    order: tuple[str, ...]

    #: Places up to here are found by a top-k, later ones by ``ordinals``.
    NEAR = 100_000

    @staticmethod
    def of(df: DataFrame, value: str | Column, order: Sequence[str]) -> Ordered:
        v = F.col(value) if isinstance(value, str) else value
        return Ordered(df.select(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], v.alias("value")), tuple(f"__o{i}" for i in range(len(order))))

    def vector(self) -> Vec:
        return Vec(ordinals(self.df, list(self.order)).select("pos", "value"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("value"))

    def item(self, i: int) -> DataFrame:
        """The item at a place; no row if there is none."""
        if i < 0:
            return self.df.limit(0).select(F.lit(i).cast("long").alias("pos"), "value")
        if i > self.NEAR:
            return self.vector().item(i)
        return self.df.orderBy(*self.order).offset(i).limit(1).select(F.lit(i).cast("long").alias("pos"), "value")

    def last(self) -> DataFrame:
        return self.df.agg(F.max_by("value", F.struct(*self.order)).alias("value"))

    def find(self, what: Column) -> DataFrame:
        """The first place of an item, or the length: rows before its first row are counted."""
        place = F.struct(*self.order)
        first = self.df.where(F.col("value").eqNullSafe(what)).agg(F.min(place).alias("__first"))
        before = F.col("__first").isNull() | (place < F.col("__first"))
        return self.df.crossJoin(F.broadcast(first)).agg(F.count(F.when(before, 1)).alias("value"))  # one row


# ------------------------------------------------------------------ chunked vectors


@dataclass(frozen=True)
class Folio:
    """Vectors shown as one long vector, without copying them."""

    chunks: tuple[Vec, ...]

    def vector(self) -> Vec:
        """Global positions: one's own plus the sizes of the chunks before.  The sizes
        are counts, one row a chunk."""
        parts = None
        for k, c in enumerate(self.chunks):
            df = c.df.select(F.lit(k).alias("chunk"), "pos", "value")
            parts = df if parts is None else parts.unionByName(df)
        sizes = parts.groupBy("chunk").agg(F.count("*").alias("n"))
        before = sizes.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        return Vec(parts.join(F.broadcast(before), "chunk").select((F.col("pos") + F.col("offset")).cast("long").alias("pos"), "value"))

    def join(self, chunk: Vec) -> Folio:
        return Folio((*self.chunks, chunk))

    def append(self, value: Column) -> Folio:
        return Folio((*self.chunks[:-1], self.chunks[-1].append(value)))

    def amend(self, i: int, value: Column) -> Vec:
        return self.vector().amend(i, value)

    def delete(self, i: int) -> Vec:
        return self.vector().delete(i)


# -------------------------------------------------------------------- keyed tables


@dataclass(frozen=True)
class MapTable:
    """A map as a table (pos, key, value) with unique keys, in order of insertion."""

    df: DataFrame

    @staticmethod
    def of(df: DataFrame, key: str, value: str, order: Order) -> MapTable:
        """Of a repeated key the last value counts, in the place of the first."""
        placed = ordinals(df.select(F.col(key).alias("key"), F.col(value).alias("value"), *order), order)
        once = placed.groupBy("key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
        return MapTable(ordinals(once, ["pos"], "__p").select(F.col("__p").alias("pos"), "key", "value"))

    def keys(self) -> Vec:
        return Vec(self.df.select("pos", F.col("key").alias("value")))

    def values(self) -> Vec:
        return Vec(self.df.select("pos", "value"))

    def lookup(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the value of its key; null if there is none.  Spark broadcasts the
        map only if its size is below the session's threshold."""
        mine = self.df.select(F.col("key").alias("__k"), F.col("value").alias(name))
        return df.join(mine, df[key].eqNullSafe(mine["__k"]), "left").drop("__k")

    def upsert(self, new: DataFrame) -> MapTable:
        """With the rows (key, value) of new: replaced in place, or added at the end in
        order of key."""
        theirs = new.groupBy("key").agg(F.last("value").alias("__v")).withColumn("__new", F.lit(True))
        both = self.df.join(theirs, "key", "full")
        value = F.when(F.col("__new"), F.col("__v")).otherwise(F.col("value"))
        late = F.col("pos").isNull()
        return MapTable(ordinals(both.select("key", value.alias("value"), late.alias("late"), F.col("pos").alias("was")), ["late", "was", "key"]).select("pos", "key", "value"))

    def delete(self, key: Column) -> MapTable:
        return MapTable(ordinals(self.df.where(~F.col("key").eqNullSafe(key)).withColumnRenamed("pos", "was"), ["was"]).select("pos", "key", "value"))

    def hash(self) -> DataFrame:
        """One number that doesn't depend on the order of entries."""
        own = F.xxhash64("key", "value")
        return self.df.agg(F.bit_xor(own).alias("hash"))
