"""Vectors that are a cell of a row (``ARRAY`` or ``MAP`` columns): indexing, changes,
and higher-order iteration, as Catalyst expressions.

A vector too long for a cell is a table in long form; ``operators.vectors`` has the
same operations for it.  A null vector gives null.  Positions count from 0; a
position out of range reads null and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]

# -------------------------------------------------------------------- iteration


def fold(a: Column, f: Binary, seed: Column | None = None) -> Column:
    """f(f(f(a0, a1), a2), ...), from seed if there is one.  Of an empty vector:
    the seed, or null."""
    if seed is not None:
        return F.aggregate(a, seed, f)
    return F.when(F.size(a) > 0, F.aggregate(_rest(a), F.get(a, F.lit(0)), f))


def unfold(a: Column, f: Binary, seed: Column | None = None) -> Column:
    """All steps of ``fold``; with a seed they begin with it."""
    grow = lambda done, x: F.array_append(done, f(F.element_at(done, -1), x))
    if seed is not None:
        return F.aggregate(a, F.array(seed), grow)
    return F.when(F.size(a) == 0, a).otherwise(F.aggregate(_rest(a), F.slice(a, 1, 1), grow))


def visited(a: Column, until: Unary, back: bool = False) -> Column:
    """The items up to the first that ``until`` holds for, that one included; from the end
    if ``back``.  All of them, if it never does."""
    items = F.reverse(a) if back else a
    stop = F.array_position(F.transform(items, lambda x: F.coalesce(until(x), F.lit(False))), True)
    return F.when(stop > 0, F.slice(items, F.lit(1), stop.cast("int"))).otherwise(items)


def mapback(a: Column, f: Binary, seed: Column | None = None) -> Column:
    """f(item, the item before); the first item stands, or meets the seed."""
    first = (lambda x: x) if seed is None else (lambda x: f(x, seed))
    return F.transform(a, lambda x, i: F.when(i == 0, first(x)).otherwise(f(x, F.get(a, i - 1))))


def mapdown(a: Column, f: Unary) -> Column:
    """f of each item."""
    return F.transform(a, f)


def zipped(a: Column, b: Column, f: Binary) -> Column:
    """f of the items side by side.  Equal lengths conform; a vector of length 1
    repeats; with an empty one the result is empty; all else is an error."""
    n, m, both = F.size(a), F.size(b), F.zip_with(a, b, f)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None))
        .when(n == m, both)
        .when((n == 0) | (m == 0), F.slice(both, 1, 0))
        .when(n == 1, F.transform(b, lambda y: f(F.get(a, F.lit(0)), y)))
        .when(m == 1, F.transform(a, lambda x: f(x, F.get(b, F.lit(0)))))
        .otherwise(F.raise_error(F.concat(F.lit("length "), n.cast("string"), F.lit(" does not conform to "), m.cast("string"))))
    )


def mapleft(a: Column, b: Column, f: Binary) -> Column:
    """f(each item of a, the whole b)."""
    return F.transform(a, lambda x: f(x, b))


def mapright(a: Column, b: Column, f: Binary) -> Column:
    """f(the whole a, each item of b)."""
    return F.transform(b, lambda y: f(a, y))


def all_pairs(a: Column, b: Column, f: Binary) -> Column:
    """A vector for each item of a, of f(item, each item of b)."""
    return mapleft(a, b, lambda x, whole: mapright(x, whole, f))


def lifted(f: Unary, a: Column, depth: int) -> Column:
    """f of every atom of a value nested ``depth`` deep."""
    return f(a) if depth == 0 else F.transform(a, lambda x: lifted(f, x, depth - 1))


def lifted2(f: Binary, a: Column, b: Column, deep_a: int, deep_b: int) -> Column:
    """f of the atoms of two nested values: an atom meets each item of a vector, and
    vectors meet as in ``zipped``, at every depth."""
    if deep_a and deep_b:
        return zipped(a, b, lambda x, y: lifted2(f, x, y, deep_a - 1, deep_b - 1))
    if deep_a:
        return F.transform(a, lambda x: lifted2(f, x, b, deep_a - 1, 0))
    if deep_b:
        return F.transform(b, lambda y: lifted2(f, a, y, 0, deep_b - 1))
    return f(a, b)


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


# --------------------------------------------------------------------- indexing


def item(a: Column, i: Column | int) -> Column:
    return F.get(a, _lit(i))


def gather(a: Column, at: Column, depth: int = 1) -> Column:
    """Items at the positions in ``at``, in its shape."""
    return lifted(lambda i: F.get(a, i.cast("int")), at, depth)


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def find(a: Column, what: Column) -> Column:
    """The first position of an item; the length if there is none."""
    at = F.array_position(a, what)
    return F.when(at == 0, F.size(a).cast("long")).otherwise(at - 1)


def indices(a: Column) -> Column:
    """Positions; of an empty vector, an empty vector."""
    n = F.size(a)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.slice(F.array(F.lit(0)), 1, 0))


def count(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a).cast("long"))


def enlist(x: Column) -> Column:
    return F.array(x)


# ---------------------------------------------------------------------- changes


def append(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def joined(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def amend(a: Column, i: Column | int, x: Column) -> Column:
    return F.transform(a, lambda old, j: F.when(j == _lit(i), x).otherwise(old))


def delete(a: Column, i: Column | int) -> Column:
    return F.filter(a, lambda _, j: j != _lit(i))


# ------------------------------------------------------------------------- sets


def as_set(a: Column) -> Column:
    """Distinct items, in the order they first appear."""
    return F.array_distinct(a)


def set_add(s: Column, x: Column) -> Column:
    return F.array_union(s, F.array(x))


def set_union(s: Column, t: Column) -> Column:
    return F.array_union(s, t)


def set_intersect(s: Column, t: Column) -> Column:
    return F.array_intersect(s, t)


def set_except(s: Column, t: Column) -> Column:
    return F.array_except(s, t)


def set_symmetric(s: Column, t: Column) -> Column:
    return F.concat(F.array_except(s, t), F.array_except(t, s))


# ------------------------------------------------------------------------- maps


def lookup(m: Column, key: Column) -> Column:
    """The value of a key; null if there is none."""
    return F.try_element_at(m, key)


def lookup_all(m: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.try_element_at(m, k))


def upsert(m: Column, key: Column, value: Column) -> Column:
    """The map with the key's value replaced in its place, or the entry added last."""
    entries = F.map_entries(m)
    old = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == key, value).otherwise(e["value"]).alias("value")))
    return F.map_from_entries(F.when(F.map_contains_key(m, key), old).otherwise(F.array_append(old, F.struct(key.alias("key"), value.alias("value")))))


def map_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_of(keys: Column, values: Column) -> Column:
    """A map of two vectors; of a repeated key the last value counts, in the place
    of the first."""
    ks = F.array_distinct(keys)
    value = lambda k: F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(ks, F.transform(ks, value))


def attributed(m: Column, attributes: Column) -> Column:
    """STRUCT(value, attributes): a map with a map of attributes of its own."""
    return F.struct(m.alias("value"), attributes.alias("attributes"))


def attribute(m: Column, name: Column) -> Column:
    """An attribute of a map; null if it has none of that name."""
    return lookup(m["attributes"], name)


def set_attribute(m: Column, name: Column, value: Column) -> Column:
    """The map with an attribute set; its entries stay."""
    return attributed(m["value"], upsert(m["attributes"], name, value))


def attributed_upsert(m: Column, key: Column, value: Column) -> Column:
    """The map with an entry changed; its attributes stay."""
    return attributed(upsert(m["value"], key, value), m["attributes"])


# ------------------------------------------------- dictionary, ragged, progression


def encoded(a: Column) -> Column:
    """STRUCT(dictionary, codes): distinct items in order of appearance, and the
    place of each item among them."""
    words = F.array_distinct(a)
    return F.struct(words.alias("dictionary"), F.transform(a, lambda x: (F.array_position(words, x) - 1).cast("int")).alias("codes"))


def decoded(e: Column) -> Column:
    return F.transform(e["codes"], lambda c: F.get(e["dictionary"], c))


def enum_append(e: Column, x: Column) -> Column:
    """A coded vector with one item more; a new word goes to the end of the dictionary."""
    words = F.array_union(e["dictionary"], F.array(x))
    return F.struct(words.alias("dictionary"), F.array_append(e["codes"], (F.array_position(words, x) - 1).cast("int")).alias("codes"))


def enum_amend(e: Column, i: Column | int, x: Column) -> Column:
    """A coded vector with an item replaced; words that no item has any more stay."""
    words = F.array_union(e["dictionary"], F.array(x))
    return F.struct(words.alias("dictionary"), amend(e["codes"], i, (F.array_position(words, x) - 1).cast("int")).alias("codes"))


def enum_delete(e: Column, i: Column | int) -> Column:
    return F.struct(e["dictionary"].alias("dictionary"), delete(e["codes"], i).alias("codes"))


def _unflattened(r: Column) -> Column:
    return ragged(r["offsets"], r["flat"])


def ragged_append(r: Column, a: Column) -> Column:
    """STRUCT(offsets, flat) with one vector more: only the ends are touched."""
    return F.struct(F.array_append(r["offsets"], F.element_at(r["offsets"], -1) + F.size(a)).alias("offsets"), F.concat(r["flat"], a).alias("flat"))


def ragged_amend(r: Column, i: Column | int, a: Column) -> Column:
    return flattened(amend(_unflattened(r), i, a))


def ragged_delete(r: Column, i: Column | int) -> Column:
    return flattened(delete(_unflattened(r), i))


def ragged(offsets: Column, flat: Column) -> Column:
    """A vector of vectors from n + 1 offsets into a flat one."""
    return F.transform(F.slice(offsets, F.lit(1), F.size(offsets) - 1), lambda start, i: F.slice(flat, start + 1, F.get(offsets, i + 1) - start))


def flattened(a: Column) -> Column:
    """STRUCT(offsets, flat) of a vector of vectors."""
    sizes = F.transform(a, lambda x: F.size(x))
    return F.struct(F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n)).alias("offsets"), F.flatten(a).alias("flat"))


def progression(length: Column | int, base: Column | int = 0, step: Column | int = 1) -> Column:
    """base, base + step, ...; a step of 0 repeats the base."""
    n = _lit(length).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: _lit(base) + i * _lit(step))).otherwise(F.slice(F.array(_lit(base) + F.lit(0).cast("long") * _lit(step)), 1, 0))


def is_sorted(a: Column, descending: bool = False) -> Column:
    """No item is smaller (larger) than the one before; true of short vectors."""
    wrong = (lambda x, before: x > before) if descending else (lambda x, before: x < before)
    return ~F.exists(F.coalesce(F.zip_with(_rest(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), wrong), F.array()), lambda bad: F.coalesce(bad, F.lit(False)))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
