"""User code: functions of columns, aggregates, parallel maps and table functions.

A function that can be written with columns should be: ``cells`` takes any such
function, and it runs compiled.  The forms here take Python functions that can't; all
of them see Arrow or pandas batches, never single rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import LibraryError


def scalar(f: Callable[..., pa.Array], returns: str) -> Callable[..., Column]:
    """A function of Arrow arrays as a function of columns."""
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(f, returnType=returns)


def itemwise(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of single values, called for all values of a batch at once."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, returnType=returns, functionType=F.PandasUDFType.SCALAR)


def folded(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, f: Callable, seed, returns: str) -> DataFrame:
    """A user fold, in order, of each group's values; a group must fit a task."""
    names = list(by)

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        done = seed
        for x in t.sort_values(list(order), kind="stable")[value]:
            done = f(done, x)
        return pd.DataFrame([[*key, done]], columns=[*names, "value"])

    schema = T.StructType([*[df.schema[b] for b in names], T.StructField("value", T._parse_datatype_string(returns))])
    return df.select(*by, *dict.fromkeys([*order, value])).groupBy(*by).applyInPandas(run, schema)


def aggregate(df: DataFrame, by: Sequence[str], value: str, step: Callable, merge: Callable, finish: Callable, returns: str, most_keys: int = 100_000) -> DataFrame:
    """A user aggregate in two parts, so a hot group is no task's alone: ``step(state, values)``
    takes the NumPy values of a group in a batch (state None at first), ``merge(a, b)`` adds two
    states, ``finish(state)`` gives the result.  States are pickled; a task that holds
    ``most_keys`` of them passes them on.  Null values are left out, and groups of none are null."""
    names = list(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, None if s is None else pickle.dumps(s)) for k, s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*names, "state"]).astype({"state": object})

        for b in batches:
            for key, part in b.groupby(names, dropna=False, sort=False)[value]:
                own = part.dropna().to_numpy()
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = step(held.get(key), own) if len(own) else held.get(key)
            if len(held) > most_keys:
                yield out()
        if held:
            yield out()

    def merged(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        done = None
        for raw in t["state"].dropna():
            s = pickle.loads(raw)
            done = s if done is None else merge(done, s)
        return pd.DataFrame([[*key, None if done is None else finish(done)]], columns=[*names, "value"])

    states = T.StructType([*[df.schema[b] for b in names], T.StructField("state", T.BinaryType())])
    schema = T.StructType([*[df.schema[b] for b in names], T.StructField("value", T._parse_datatype_string(returns))])
    return df.select(*names, value).mapInPandas(partial, states).groupBy(*names).applyInPandas(merged, schema)


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A function of Arrow batches over all partitions in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield f(b)

    return df.mapInArrow(run, schema)


def register(spark: SparkSession, name: str, f: Callable, returns: str, kind: str = "itemwise") -> None:
    """A user function under a name of SQL; kind: itemwise, scalar or table."""
    if not callable(f):
        raise LibraryError(f"{name} is no function")
    if kind == "table":
        spark.udtf.register(name, F.udtf(f, returnType=returns))
    elif kind in ("itemwise", "scalar"):
        spark.udf.register(name, itemwise(f, returns) if kind == "itemwise" else scalar(f, returns))
    else:
        raise LibraryError(f"no kind {kind}")


class Steps:
    """A table function: ``n`` rows (pos, value) of an arithmetic progression."""

    def eval(self, n: int, base: int, step: int):
        for k in range(n):
            yield k, base + k * step
