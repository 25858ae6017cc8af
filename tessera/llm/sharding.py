"""Sharding by extendible hashing.

A document's shard is named by a prefix of the bits of its hash.  The directory
maps prefixes to shards: a bucket is split on its next bit only while its bytes
exceed the limit, so small buckets stay shallow.  Bytes are summed once per
prefix of a base depth (pre-aggregated, one row per prefix), the sums of all
shorter prefixes are rolled up from those, and the shard of a prefix is its
shortest bucket within the limit.  Prefixes whose bucket is still too large at
the base depth go on to the next depth; nothing else is touched again.

Edge cases: null texts have 0 bytes; a null id hashes as a value of its own; an
empty table gives no shards; a single document above the limit cannot be split
and stands alone in a shard marked oversize.  Rows that share all hashed bits
(repeats of one id, null ids) cannot be parted by hash: past the last bit they are cut by
their running bytes, and the shard's name gets a number after a point.  That cut works on
range partitions, so no task holds all rows of an id.  Extra columns are ignored by
``shards`` and kept by ``write_shards``, which writes every row once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, written
from tessera.operators.vectors import running

#: Bits of the hash that can be used; they fit a positive long.
DEPTH = 60
STEP = 6


def _hashed(key):
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, DEPTH // 4), 16, 10).cast("long")


_H, _N = "__h", "__n_bytes"


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """From rows (__h, __n_bytes): for each depth that was needed, which prefix of that
    depth (leaf) belongs to which bucket (depth, bucket, bucket_bytes; null: go on to the
    next depth)."""
    total = rows.agg(F.sum(_N)).first()[0] or 0
    depth = min(DEPTH, math.ceil(math.log2(max(1, total / limit))) + STEP)
    least, found, rest = 0, [], rows
    while True:
        leaves = written(rest.groupBy(F.shiftright(_H, DEPTH - depth).alias("leaf")).agg(F.sum(_N).alias("bytes"), F.count("*").alias("n")), "leaves")
        ups = leaves.select("leaf", "bytes", "n", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("depth")).withColumn("bucket", F.expr(f"leaf >> ({depth} - depth)"))
        sums = ups.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes"), F.sum("n").alias("bucket_n"))
        fits = (F.col("bucket_bytes") <= limit) | (F.col("bucket_n") == 1)
        named = ups.join(sums.where(fits), ["depth", "bucket"]).groupBy("leaf").agg(F.min(F.struct("depth", "bucket", "bucket_bytes")).alias("__at"))
        found.append((depth, written(leaves.select("leaf").join(named, "leaf", "left").select(F.col("leaf").alias("__leaf"), "__at"), "directory")))
        here = found[-1][1]
        if depth == DEPTH or here.where("__at is null").isEmpty():
            return found
        rest = written(rest.withColumn("__leaf", F.shiftright(_H, DEPTH - depth)).join(here.where("__at is null"), "__leaf").select(_H, _N), "oversized")
        least, depth = depth + 1, min(DEPTH, depth + STEP)


def _assigned(rows: DataFrame, levels: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """rows (__h, __n_bytes and others) with __shard (bits), __depth and __bytes (of the shard)."""
    out, rest = None, rows
    for depth, here in levels:
        seen = rest.withColumn("__leaf", F.shiftright(_H, DEPTH - depth)).join(here, "__leaf").drop("__leaf")
        bits = F.when(F.col("__at.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(__at.bucket), __at.depth, '0')"))
        own = seen.where("__at is not null").select(*rows.columns, bits.alias("__shard"), F.col("__at.depth").cast("int").alias("__depth"), F.col("__at.bucket_bytes").alias("__bytes"))
        out = own if out is None else out.unionAll(own)
        rest = seen.where("__at is null").select(*rows.columns)
    depth, here = levels[-1]
    if depth < DEPTH or here.where("__at is null").isEmpty():
        return out
    return out.unionAll(_cut(rest, limit))


def _cut(rest: DataFrame, limit: int) -> DataFrame:
    """Rows with equal hashes, cut by running bytes into runs within the limit (each run
    begins where the running sum passes a multiple of half the limit); a row above half
    the limit is a run of its own."""
    half = max(1, limit // 2)
    # equal rows need something to be told apart by, or they would meet in one range
    rest = written(rest.withColumn("__row", F.monotonically_increasing_id()), "one-hash")
    order = [_N, "__row"]
    big = running(rest.where(F.col(_N) > half).withColumn("__one", F.lit(1)), order, "__one", "count", "__k", by=[_H]).drop("__one").withColumn("__run", F.concat(F.lit("b"), F.col("__k").cast("string")))
    small = running(rest.where(F.col(_N) <= half), order, _N, "sum", "__k", by=[_H]).withColumn("__run", F.floor((F.col("__k") - F.col(_N)) / half).cast("string"))
    cut = big.unionByName(small).withColumn("__shard", F.concat(F.lpad(F.bin(_H), DEPTH, "0"), F.lit("."), "__run")).drop("__k", "__run", "__row")
    sums = written(cut.groupBy(F.col("__shard").alias("__of")).agg(F.sum(_N).alias("__bytes")), "runs")
    columns = [c for c in rest.columns if c != "__row"]
    return cut.join(sums, F.col("__shard") == F.col("__of")).select(*columns, "__shard", F.lit(DEPTH).alias("__depth"), "__bytes")


def _sized(docs: DataFrame, id_column: str, text_column: str):
    return F.coalesce(F.octet_length(docs[text_column]), F.lit(0)).cast("long").alias(_N), _hashed(docs[id_column]).alias(_H)


def shards(docs: DataFrame, limit: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversize) of each row of docs.
    ``shard`` is the bucket's bits as a string ("" is the root)."""
    rows = written(docs.select(docs[id_column].alias("doc_id"), *_sized(docs, id_column, text_column)), "hashed")
    named = _assigned(rows, directory(rows, limit), limit)
    return named.select("doc_id", F.col(_N).alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__bytes").alias("shard_bytes"), (F.col("__bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write docs as Parquet with one folder per shard (shard=s followed by its bits);
    every row is written once, with all its columns."""
    rows = written(docs.select(*_sized(docs, id_column, text_column)), "hashed")
    named = _assigned(docs.select(*docs.columns, *_sized(docs, id_column, text_column)), directory(rows, limit), limit)
    folder = fresh(docs, "shard")
    out = named.select(*docs.columns, F.concat(F.lit("s"), "__shard").alias(folder))
    out.repartition(folder).write.mode("overwrite").partitionBy(folder).parquet(path)


LIMIT = 1 << 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: documents into shards of at most 1 MiB of text."""
    return shards(table(spark, sf_dir, "documents"), LIMIT)


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
u AS (SELECT g.depth, h >> ({DEPTH} - g.depth) AS bucket, sum(n_bytes) AS b, count(*) AS n FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 31)) g GROUP BY ALL),
m AS (SELECT d.doc_id, d.n_bytes, d.h, min(u.depth) AS depth FROM d JOIN u ON u.bucket = d.h >> ({DEPTH} - u.depth) AND (u.b <= {LIMIT} OR u.n = 1) GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, substr(right(format('{{:060b}}', h), {DEPTH}), 1, m.depth) AS shard, m.depth, CAST(u.b AS BIGINT) AS shard_bytes, u.b > {LIMIT} AS oversize
FROM m JOIN u ON u.depth = m.depth AND u.bucket = m.h >> ({DEPTH} - m.depth)
"""
