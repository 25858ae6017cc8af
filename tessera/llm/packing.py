"""Packing by optimal length buckets.

A global histogram of lengths (one row per length bin) is reduced on the
executors; a dynamic programme over it chooses the bucket boundaries that
minimise padding.  Bins keep the ten leading bits of a length, so lengths up to
1,023 are exact and longer bins are at most 0.2 % wide; there are at most 28,000
bins whatever the input, which is the proven bound of what the driver gets.  A
bin has its largest length, count and sum of lengths, so a boundary is the length
of a document and the cost of a choice is exact.  Where all lengths are below 1,024 the
choice is the optimum; else boundaries inside a bin are not tried, and as moving a boundary
of the optimum up to its bin's largest length pads each document by less than a bin's width
more, the total padding exceeds the optimum by less than 0.2 % of the padded lengths.
Inside a bucket, batches hold as many documents as the token budget allows at
the bucket's padded length.

Hot buckets: each bucket is dealt into streams of about ``STREAM`` documents by
a hash of the id, and batches form inside a stream, so no task sees more than a
stream of narrow rows; the price is one unfilled batch a stream.

Edge cases: null or blank texts have length 0 and go to the first bucket; a
document longer than the budget is a batch of its own; an empty table gives an
empty result; ties and repeated rows are ordered by id and then share places in
any order (their rows are equal); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, table, written

STREAM = 20_000


def top_of_bin(length):
    """The largest length of the bin that keeps the ten leading bits of length."""
    bits = F.greatest(F.length(F.bin(length)) - 10, F.lit(0))
    return F.when(bits == 0, length).otherwise(F.expr("0L") + (F.call_function("shiftleft", F.call_function("shiftright", length, bits) + 1, bits) - 1)).cast("long")


def best_boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int, sums: np.ndarray | None = None) -> list[int]:
    """At most ``buckets`` of the tops, the last included, that minimise the sum of
    count * boundary - sum of lengths over the histogram; without ``sums`` all lengths
    of a bin are its top.  Each layer of the programme is solved by divide and
    conquer, as its best cuts never move left."""
    n = len(tops)
    if n == 0:
        return []
    many = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    held = np.concatenate([[0], np.cumsum(counts * tops.astype(np.float64) if sums is None else sums, dtype=np.float64)])
    cost = lambda i, j: tops[j - 1] * (many[j] - many[i]) - (held[j] - held[i])  # noqa: E731  bins i .. j - 1 padded to the top of the last
    at = np.arange(1, n + 1)
    best = np.concatenate([[0.0], cost(0, at)])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            costs = best[i] + cost(i, j)
            k = int(costs.argmin())
            new[j], cut[j] = costs[k], i[k]
            todo += [(lo, j - 1, left, int(i[k])), (j + 1, hi, int(i[k]), right)]
        best = new
        cuts.append(cut)
    chosen, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        chosen.append(int(tops[j - 1]))
        j = int(cut[j])
    return sorted(set(chosen))


def packed(docs: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, place, padding) of each row of docs (doc_id, text).
    A token is a word here; ``packed_lengths`` takes any lengths."""
    return packed_lengths(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")), buckets, budget)


def packed_lengths(lengths: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """As ``packed``, from (doc_id, n_tokens)."""
    rows = written(lengths.select("doc_id", "n_tokens", top_of_bin(F.col("n_tokens")).alias("top")), "lengths")
    # the largest length of a bin stands for its top
    bins = sorted(tuple(r)[1:] for r in rows.groupBy("top").agg(F.max("n_tokens"), F.count("*"), F.sum(F.col("n_tokens").cast("double"))).collect())
    tops, counts = np.array([b[0] for b in bins], np.int64), np.array([b[1] for b in bins], np.int64)
    edges = best_boundaries(tops, counts, buckets, np.array([b[2] for b in bins]))
    if not edges:
        edges = [0]
    held = np.zeros(len(edges), np.int64)
    np.add.at(held, np.searchsorted(edges, tops), counts)
    known = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(int(e)).cast("long").alias("padded_to"), F.lit(int(max(1, -(-int(h) // STREAM)))).cast("long").alias("streams")) for i, (e, h) in enumerate(zip(edges, held, strict=True))])
    which = F.expr("aggregate(array(" + ", ".join(f"{e}L" for e in edges[:-1]) + "), 0, (n, e) -> n + if(n_tokens > e, 1, 0))") if len(edges) > 1 else F.lit(0)
    named = rows.select("doc_id", "n_tokens", F.get(known, which).alias("b")).select("doc_id", "n_tokens", "b.*")
    named = named.withColumn("stream", F.pmod(F.xxhash64("doc_id"), F.col("streams")))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    number = F.row_number().over(Window.partitionBy("bucket", "stream").orderBy("doc_id", "n_tokens")) - 1
    batch = F.concat_ws("-", "bucket", "stream", F.floor(F.col("number") / fits))
    return named.withColumn("number", number).select("doc_id", "n_tokens", "bucket", "padded_to", batch.alias("batch"), (F.col("number") % fits).cast("long").alias("place"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: 16 buckets, 65,536 tokens a batch."""
    return packed(table(spark, sf_dir, "documents"))
