"""Values on disk: single tables, trees of values, sibling files, and workspaces.

A value is a table (DataFrame), a literal, or a dict or list of values.  Each table
is a Parquet dataset; a JSON manifest beside it tells how the tree is put together.
Reading is lazy: nothing but manifests is read until a table is used.

Layouts: ``file`` keeps one table at the path itself; ``directory`` gives every child
a numbered folder of its own; ``multi`` puts children beside each other as
``stem-0``, ``stem-1`` and so on.  All read back what they were written from.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import DriveError, wrapped
from tessera.operators.residency import PathLocks

LOCKS = PathLocks()
MANIFEST = "manifest.json"


# ---------------------------------------------------- small files of any file system


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise DriveError(f"there is no {path}")
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def ensure_folder(spark: SparkSession, path: str, replace: bool = False) -> None:
    p, fs = _fs(spark, path)
    if fs.exists(p):
        if not replace:
            raise DriveError(f"{path} exists")
        fs.delete(p, True)
    fs.mkdirs(p)


# ---------------------------------------------------------------------- whole values


def write(value, path: str, spark: SparkSession, layout: str = "directory", replace: bool = True, one_file: bool = False) -> None:
    """Write a value; ``one_file`` puts a table in a single Parquet file."""
    with LOCKS.exclusive(path), wrapped():
        if layout == "file":
            if not isinstance(value, DataFrame):
                raise DriveError("only a table is a single file")
            _write_table(value, path, replace, one_file)
        elif layout == "directory":
            ensure_folder(spark, path, replace)
            _write_tree(value, path, spark)
        elif layout == "multi":
            children = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
            for k, (_, child) in enumerate(children):
                write(child, f"{path}-{k}", spark, "directory", replace)
            put_text(spark, f"{path}.json", json.dumps({"kind": "map" if isinstance(value, dict) else "list", "keys": [k for k, _ in children]}))
        else:
            raise DriveError(f"no layout {layout}")


def _write_table(df: DataFrame, path: str, replace: bool, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite" if replace else "errorifexists").parquet(path)


def _write_tree(value, path: str, spark: SparkSession) -> None:
    if isinstance(value, DataFrame):
        _write_table(value, f"{path}/self", True)
        said: dict = {"kind": "table"}
    elif isinstance(value, (dict, list, tuple)):
        children = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        for k, (_, child) in enumerate(children):
            _write_tree(child, f"{path}/{k}", spark)
        said = {"kind": "map" if isinstance(value, dict) else "list", "keys": [k for k, _ in children]}
    else:
        said = {"kind": "atom", "value": value}
    put_text(spark, f"{path}/{MANIFEST}", json.dumps(said))


def read(path: str, spark: SparkSession):
    """What was written at a path, whatever its layout."""
    with LOCKS.shared(path), wrapped():
        if exists(spark, f"{path}/{MANIFEST}"):
            return _read_tree(path, spark)
        if exists(spark, f"{path}.json"):
            said = json.loads(get_text(spark, f"{path}.json"))
            children = [_read_tree(f"{path}-{k}", spark) for k in range(len(said["keys"]))]
            return dict(zip(said["keys"], children, strict=True)) if said["kind"] == "map" else children
        if not exists(spark, path):
            raise DriveError(f"there is no {path}")
        return spark.read.parquet(path)


def _read_tree(path: str, spark: SparkSession):
    said = json.loads(get_text(spark, f"{path}/{MANIFEST}"))
    if said["kind"] == "table":
        return spark.read.parquet(f"{path}/self")
    if said["kind"] == "atom":
        return said["value"]
    children = [_read_tree(f"{path}/{k}", spark) for k in range(len(said["keys"]))]
    return dict(zip(said["keys"], children, strict=True)) if said["kind"] == "map" else children


open_value = read


def raw_bytes(spark: SparkSession, path: str, offset: int = 0, size: int | None = None) -> DataFrame:
    """(path, bytes) of files without a header, from an offset on."""
    whole = spark.read.format("binaryFile").load(path)
    n = F.lit(size) if size is not None else F.octet_length("content")
    return whole.select("path", F.substring("content", F.lit(offset + 1), n).alias("bytes"))


# ---------------------------------------------------------------------- workspaces


def save_workspace(names: dict, path: str, spark: SparkSession) -> None:
    """All named values of an environment.  Those still read from the old save are
    read whole before it is replaced: the new one is written beside it first."""
    beside = f"{path.rstrip('/')}.new"
    write(dict(names), beside, spark, "directory")
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    if not fs.rename(_fs(spark, beside)[0], p):
        raise DriveError(f"{path} can't be replaced")


def load_workspace(path: str, spark: SparkSession, views: bool = False) -> dict:
    """The saved names; with ``views`` tables are also registered as temp views."""
    got = read(path.rstrip("/"), spark)
    if not isinstance(got, dict):
        raise DriveError(f"{path} is no workspace")
    for name, value in got.items():
        if views and isinstance(value, DataFrame):
            value.createOrReplaceTempView(name)
    return got
