"""Quality by kernel ridge regression on document statistics.

Statistics of a whole text (lengths, character classes, repetition, lines) are
standardised and mapped to random Fourier features, which approximate a Gaussian
kernel.  Each partition of labelled rows sums its part of the normal equations;
the sums are added by a group-by, and the driver solves one small system.  Raw
scores are calibrated by isotonic regression over a histogram of fixed size.

All labelled rows that are not held out are used; what reaches the driver is
bounded by the number of features and of bins.  Texts are read once: the
statistics are written to the shared folder.  Labels, lang, source and doc_id
are never inputs of a score.

Edge cases: null and empty texts have all statistics 0 and get that text's
score; a very long text takes some 100 bytes of memory a word; null labels are not used; labels repeating a doc_id count by their
smallest; without labels of both kinds every row scores 1 if all known labels are
1 and 0 otherwise; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bound_arrow, counted, hash_runs, list_array, pieces, spans, table, text_buffer, written
from tessera.llm.toxicity import held_out

FEATURES, RIDGE, BINS = 128, 1e-3, 2048

_CLASSES = ["space", "newline", "upper", "lower", "digit", "bang", "bar", "symbol", "stop", "other", "high"]
_CLASS = np.full(256, _CLASSES.index("other"), np.int32)
for _name, _members in (("space", b" \t\v\f\r"), ("newline", b"\n"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"), ("bang", b"!?"), ("bar", b"|"), ("symbol", b"%*$#&@^~+=<>_/\\{}[]"), ("stop", b".,;:'\"()-"), ("high", bytes(range(128, 256)))):
    _CLASS[list(_members)] = _CLASSES.index(_name)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LETTER = np.zeros(256, np.int8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_ODD = np.zeros(256, bool)
_ODD[list(b"!|%*$#&@^~+=<>_/\\{}[]")] = True
DIM = len(_CLASSES) + 12
_AT_ONCE = 1 << 20


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of DIM statistics for each text."""
    n = len(off) - 1
    out = np.zeros((n, DIM))
    if not len(data):
        return out
    sizes = np.diff(off)
    counts = np.zeros((n, len(_CLASSES)), np.int64)
    for lo in range(0, len(data), _AT_ONCE):  # a part of the texts at once, or a part of one
        hi = min(len(data), lo + _AT_ONCE)
        i, j = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi))
        held = np.diff(np.clip(off[i : j + 1], lo, hi))
        at = np.repeat(np.arange(j - i, dtype=np.int32) * len(_CLASSES), held) + _CLASS[data[lo:hi]]
        counts[i:j] += np.bincount(at, minlength=(j - i) * len(_CLASSES)).reshape(j - i, -1)
    out[:, : len(_CLASSES)] = counts / np.maximum(sizes, 1)[:, None]
    starts, ends, first = spans(data, off, SPACE)
    words = np.diff(first)
    per, at = np.maximum(words, 1), first[:-1]
    lengths = (ends - starts).astype(np.float64)
    hashes = hash_runs(data, starts, ends)

    def per_text(x):
        sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return sums[first[1:]] - sums[at]

    def within(flags):
        return counted(data, flags, ends) - counted(data, flags, starts)

    mean = per_text(lengths) / per
    letters, upper = within(_LETTER), within(_UPPER)
    same = np.zeros(len(starts))
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[words > 0]] = 0
    lines, line_ends, line_first = spans(data, off, _NEWLINE)
    line_hash = hash_runs(data, lines, line_ends)
    distinct, distinct_lines = np.zeros(n), np.zeros(n)
    for i in range(n):
        distinct[i] = len(np.unique(hashes[at[i] : first[i + 1]]))
        distinct_lines[i] = len(np.unique(line_hash[line_first[i] : line_first[i + 1]]))
    n_lines = np.diff(line_first)
    out[:, len(_CLASSES) :] = np.stack(
        [
            np.log1p(words) / 8,
            np.minimum(mean, 30) / 6,
            np.minimum(np.sqrt(np.maximum(per_text(lengths**2) / per - mean**2, 0)), 30) / 6,
            per_text(same) / per,
            distinct / np.sqrt(per) / 8,
            distinct / per,
            distinct_lines / np.maximum(n_lines, 1),
            per_text((upper >= 2) & (upper == letters)) / per,
            per_text(letters == 0) / per,
            per_text(_ODD[data[ends - 1]] if len(ends) else same) / per,
            np.log1p(words / np.maximum(n_lines, 1)) / 6,
            words > 0,
        ],
        axis=1,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores, rising
    values: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y, by pooling adjacent violators; as
    (mean x, value) of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, weight, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _stats(batches):
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        for i, j in pieces(off):
            s = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), list_array(s.ravel(), np.full(j - i, DIM), pa.float64())], ["doc_id", "stats"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row of docs (doc_id, text)."""
    bound_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_stats, "doc_id long, stats array<double>")


def _summed(model: Model):
    def run(batches):
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in batches:
            z = np.concatenate([model.features(_matrix(batch.column("stats"))), batch.column("y").to_numpy().astype(float)[:, None]], axis=1)
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 2), pa.int32()), list_array(total.ravel(), np.full(FEATURES + 2, FEATURES + 2), pa.float64())], ["i", "row"])

    return run


def _applied(method):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "stats"), pa.array(method(_matrix(batch.column("stats"))))], [*(n for n in batch.schema.names if n != "stats"), "score"])

    return run


def fit(stats: DataFrame, labels: DataFrame, seed: int = 3) -> Model | float:
    """A model from (doc_id, stats) and labels (doc_id, quality), or the only label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    rows = written(stats.join(known, "doc_id").select("y", "stats"), "labelled")
    sums = [f"sum(stats[{i}]) a{i}, sum(stats[{i}] * stats[{i}]) b{i}" for i in range(DIM)]
    got = rows.selectExpr("count(*) n", "min(y) lo", "max(y) hi", *(x for s in sums for x in s.split(", "))).first()
    if not got.n or got.lo == got.hi:
        return float(bool(got.n and got.lo == 1))
    mean = np.array([got[f"a{i}"] for i in range(DIM)]) / got.n
    scale = np.sqrt(np.maximum(np.array([got[f"b{i}"] for i in range(DIM)]) / got.n - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(DIM), (DIM, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.0]))
    parts = rows.mapInArrow(_summed(model), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    total = np.zeros((FEATURES + 2, FEATURES + 2))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    model.beta = np.linalg.solve(total[:-1, :-1] + RIDGE * got.n * np.diag([1.0 / FEATURES] * FEATURES + [0.0]), total[:-1, -1])
    scored = rows.mapInArrow(_applied(model.raw), "y int, score double")
    bins = scored.groupBy(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "score")) + 1) / 3 * BINS).alias("bin")).agg(F.avg("score"), F.avg("y"), F.count("*")).orderBy("bin").collect()
    model.knots, model.values = isotonic(*(np.array([float(r[k]) for r in bins]) for k in (1, 2, 3)))
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    stats = written(text_statistics(docs), "stats")
    model = fit(stats, labels)
    if isinstance(model, float):
        return stats.select("doc_id", F.lit(model).alias("score"))
    return stats.mapInArrow(_applied(model.scores), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: quality of all documents."""
    scores = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
