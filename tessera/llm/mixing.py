"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source; each source gets a share of the mix by its weight,
held below a multiple of its own size, and what is cut off goes to the others by
weight (water-filling).  A source's repetition rate is its target over its size;
a document is taken floor(rate) times, and once more if a uniform number hashed
from its id and the seed is below the rate's fraction.

The only table that meets in one task has one row per source, some 50 bytes each: a source
is a corpus here, and ten million of them still fit a task, which sorts and spills.  Documents are
reduced to four narrow columns before they are dealt by source, the sums are
pre-aggregated, and a hot source is a skewed join that AQE can split.

Edge cases: null or blank texts have size 0 and are taken 0 words; the null
source is a source of its own, last in order; an empty table gives an empty
result; rows that repeat an id get the same draw; a null id has one draw of its
own; extra columns are ignored by ``mixture`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, n_words, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def uniform(key, seed: str):
    """A number in [0, 1) from the first 60 bits of a digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") / F.lit(float(2**60))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With r = most * size / weight, the sources of least r are full.  If the first
    k in order of r are full, the level of the others is what is left over the
    weight left; the right k is the first at which the next source is not full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(pattern, (F.row_number().over(order) - 1) % len(weights)).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.lit(float(share)) * F.col("all_size") - F.lit(float(most)) * F.col("full_size")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.lit(float(most)) * F.col("source_size"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(whole)["level"])
    )
    cap = F.lit(float(most)) * F.col("source_size")
    return filled.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), cap), cap).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """For each row of docs (doc_id, source, text): its size, its source's size and
    target, its copies and the words they take."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # written, it has a known size: Spark broadcasts it below the session's threshold
    wanted = written(targets(per_source, weights, share, most).withColumnRenamed("source", "of_source"), "targets")
    rows = sized.join(wanted, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(uniform(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns kept.

    The rates are written first, so that their size is known when the join is planned:
    below the session's threshold for broadcasts, texts stay where they were read.
    """
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(per_source, weights, share, most)
    of, by, copy = (fresh(docs, n) for n in ("__of", "__by", "__copy"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = written(wanted.select(F.col("source").alias(of), rate.alias(by)), "rates")
    whole = F.floor(by)
    copies = (whole + F.when(uniform(F.col("doc_id"), seed) < F.col(by) - whole, 1).otherwise(0)).cast("int")
    taken = docs.join(rates, docs["source"].eqNullSafe(rates[of])).withColumn(copy, copies).where(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: weights 5, 2, 1 over 150 % of all words, at most twice a source."""
    return mixture(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM g),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size,
  CAST(coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS full_size,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS open_weight
  FROM r WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * all_size - CAST(2.0 AS DOUBLE) * full_size) / open_weight AS level FROM f),
h AS (SELECT level FROM l WHERE level * weight <= CAST(2.0 AS DOUBLE) * source_size ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), level LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM h) * weight, CAST(2.0 AS DOUBLE) * source_size), CAST(2.0 AS DOUBLE) * source_size) AS target FROM r),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""
