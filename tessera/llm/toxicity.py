"""Toxicity by a convolutional text classifier, trained in numpy.

A term is a run of letters and digits.  Its embedding is the sum of three hashed
rows: of the whole term and of its first four and five bytes, so an unseen form
of a known stem still has most of its meaning.  Filters of widths 1, 2 and 3 run
over the terms of the whole text; their largest responses make the logit.

Fitting.  A bounded sample of labelled rows is turned to term ids on the executors and
trained on at the driver, less one fifth: in a total order by hash, at most ``fit_rows``
rows whose ids take ``fit_bytes`` at most (12 bytes a term; both are parameters; a row that
alone takes a sixteenth of that, 500,000 terms, is passed over).  Rows are fetched one
partition at a time.  Rows start from smoothed log-odds of their term.

Calibration.  All labelled rows that are neither held out nor learnt from, long
texts too, are scored on the executors and counted in a histogram of fixed size,
by language and logit.  The language of a text is told from its own function
words, each language gets the threshold of the best F1 over its rows, and a score
is the sigmoid of the logit's distance from it, so 0.5 is every language's
threshold.  A language with fewer than 40 such rows or 10 toxic ones gets the
common threshold of all rows; if there are fewer than 10 toxic ones in all, rows
learnt from are counted as well.  Labels, lang, source and doc_id are never
inputs of a score.

Scoring is one pass over the texts, which are never shuffled; calibration shuffles
(doc_id, language, logit).

Edge cases: null, empty and symbol-only texts have no terms and get the score of
the empty text; labels that are null are not used; labels that repeat a doc_id
count as toxic if any does; without labels of both kinds in the sample all rows
score 0; rows that share a doc_id with one learnt from are not calibrated on;
repeated rows score alike but for the last digits of single precision (a sum's order
depends on the batch); a null doc_id keeps its row; extra columns are
ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NOT_TERM, bound_arrow, fresh, hash_runs, pieces, spans, table, text_buffer, written

BUCKETS = 1 << 17
PAD = 3 * BUCKETS
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
TAIL = max(WIDTHS) - 1
#: Bins of the calibration's histogram, over logits from -SPAN to SPAN.
BINS, SPAN = 4096, 32
FIT_BYTES = 96 << 20

#: Function words by language; a text is of the language with the most of them.
LANGUAGES = {
    "en": "the of and to in is that it for with was are be this on as by from an at or not have which but".split(),
    "de": "der die das und zu den von mit ist des im für auf ein eine nicht sich dem als auch werden wird sie er oder".split(),
    "fr": "le les et des du une est dans pour que qui pas sur par avec sont au aux ce il elle ne plus nous vous ou".split(),
    "es": "el los las del que y se por con para una su al lo como más pero sus esta este son no ha hay está".split(),
}


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return hash_runs(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def _language_table() -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int8)
    for k, words in enumerate(LANGUAGES.values()):
        out[(_hash_words(words) % np.uint64(BUCKETS)).astype(np.int64)] = k
    return out


_LANGUAGE = _language_table()


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): three table rows for each term, and where each text begins;
    TAIL pads follow each text."""
    starts, ends, first = spans(data, off, NOT_TERM)
    n, texts = len(starts), len(off) - 1
    ids = np.full((n + TAIL * texts, 3), PAD, np.int32)
    place = np.arange(n) + TAIL * np.repeat(np.arange(texts), np.diff(first))
    for k, most in enumerate((None, 4, 5)):
        cut = ends if most is None else np.minimum(ends, starts + most)
        ids[place, k] = (hash_runs(data, starts, cut) % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS
    return ids, first + TAIL * np.arange(texts + 1)


def languages(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language of each text; the number of languages if none is told."""
    known = np.full(len(ids), -1, np.int8)
    real = ids[:, 0] < BUCKETS
    known[real] = _LANGUAGE[ids[real, 0]]
    counts = np.stack([np.add.reduceat(known == k, first[:-1]) if len(first) > 1 else np.zeros(0, int) for k in range(len(LANGUAGES))], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES))


@dataclass
class Model:
    table: np.ndarray  # (PAD + 1, DIM); the last row is zero
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # by language, the last for untold ones

    def responses(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter responses at each term; at pads of a text with terms, minus infinity."""
        e = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        h = np.empty((len(e), FILTERS * len(WIDTHS)), np.float32)
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            part = e @ f[0] + b
            for o in range(1, w):
                part[:-o] += e[o:] @ f[o]
            h[:, k * FILTERS : (k + 1) * FILTERS] = part
        pads = ids[:, 0] == PAD
        pads[first[:-1][ids[first[:-1], 0] == PAD]] = False  # texts without terms have only pads
        h[pads] = -np.inf
        return h

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) <= 1:
            return np.zeros(0)
        pooled = np.maximum.reduceat(self.responses(ids, first), first[:-1], axis=0)
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = self.logits(ids, first) - self.thresholds[languages(ids, first)]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_threshold(bins: np.ndarray) -> float:
    """Between two bins, of the best F1; of several, the middle one.  Rows of bins,
    by rising logit: least and largest logit, rows, toxic rows."""
    least, most, n, toxic = bins[::-1].T
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = good[len(good) // 2]
    below = most[k + 1] if k + 1 < len(n) else least[k] - 1
    return float((least[k] + below) / 2)


def thresholds(bins: np.ndarray) -> np.ndarray:
    """By language, from rows of (learnt from, language, bin, least and largest logit,
    rows, toxic rows)."""

    def merged(rows: np.ndarray) -> np.ndarray:
        _, at = np.unique(rows[:, 2], return_inverse=True)
        out = np.tile([np.inf, -np.inf, 0.0, 0.0], (at.max() + 1, 1))
        np.minimum.at(out[:, 0], at, rows[:, 3])
        np.maximum.at(out[:, 1], at, rows[:, 4])
        np.add.at(out[:, 2:], at, rows[:, 5:])
        return out

    kept = bins[bins[:, 0] == 0]
    if kept[:, 6].sum() < 10:
        kept = bins
    out = np.full(len(LANGUAGES) + 1, best_threshold(merged(kept)))
    for k in range(len(out)):
        own = kept[kept[:, 1] == k]
        if own[:, 5].sum() >= 40 and own[:, 6].sum() >= 10:
            out[k] = best_threshold(merged(own))
    return out


def train(texts: list[np.ndarray], y: np.ndarray, learnt: np.ndarray, epochs: int = 8, seed: int = 5) -> Model:
    """texts: the ids of each text, pads included; y: 0 or 1; learnt: rows to train on.
    Thresholds are left at 0."""
    rng = np.random.default_rng(seed)
    fit = np.flatnonzero(learnt)
    rate = float(y[fit].mean())
    seen, positive = np.zeros(PAD + 1), np.zeros(PAD + 1)
    for i in fit:
        u = np.unique(texts[i])
        seen[u] += 1
        positive[u] += y[i]
    odds = lambda p: np.log(p / (1 - p))
    start = odds((positive + 4 * rate) / (seen + 4)) - odds(rate)
    table_ = np.zeros((PAD + 1, DIM), np.float32)
    known = seen > 0
    table_[known, 1:] = rng.normal(0, 0.1, (int(known.sum()), DIM - 1))
    table_[:, 0] = np.clip(start, -3, 6) / 4
    table_[PAD] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = 1.0
    bias = [np.full(FILTERS, -0.3, np.float32) for _ in WIDTHS]
    n_out = FILTERS * len(WIDTHS)
    model = Model(table_, filters, bias, rng.normal(0.2, 0.05, n_out).astype(np.float32), -1.0, np.zeros(len(LANGUAGES) + 1))
    m2 = [np.full_like(x, 1e-6) for x in (*filters, *bias, model.out)]
    out_bias_2, table_2 = 1e-6, np.full(PAD + 1, 1e-6)
    weight = np.where(y == 1, min(4.0, 0.5 / max(rate, 1e-3)), 1.0)
    for epoch in range(epochs):
        step = 0.1 / (1 + epoch)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            sizes = np.array([len(texts[i]) for i in at])
            first = np.concatenate([[0], np.cumsum(sizes)])
            ids = np.concatenate([texts[i] for i in at])
            h = model.responses(ids, first)
            top = np.stack([first[t] + h[first[t] : first[t + 1]].argmax(axis=0) for t in range(len(at))])
            pooled = np.take_along_axis(h, top, axis=0)
            live = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ model.out + model.out_bias, -30, 30)))
            g = (p - y[at]) * weight[at] / len(at)
            g_out = live.T @ g + 1e-4 * model.out
            g_pool = g[:, None] * model.out * (pooled > 0)
            grads = [np.zeros_like(f) for f in filters], [np.zeros_like(b) for b in bias]
            rows, row_grads = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                t, gp = top[:, cols].ravel(), g_pool[:, cols].ravel()
                c = np.tile(np.arange(FILTERS), len(at))
                np.add.at(grads[1][k], c, gp)
                for o in range(w):
                    own = ids[np.minimum(t + o, len(ids) - 1)]
                    e = table_[own].sum(axis=1)
                    by = np.zeros((FILTERS, DIM), np.float32)
                    np.add.at(by, c, e * gp[:, None])
                    grads[0][k][o] += by.T
                    rows.append(own.ravel())
                    row_grads.append(np.repeat(filters[k][o].T[c] * gp[:, None], 3, axis=0))
            for x, gx, s in zip((*filters, *bias, model.out), (*grads[0], *grads[1], g_out), m2, strict=True):
                s += gx**2
                x -= (step * gx / np.sqrt(s)).astype(np.float32)
            out_bias_2 += g.sum() ** 2
            model.out_bias -= step * g.sum() / np.sqrt(out_bias_2)
            r, gr = np.concatenate(rows), np.concatenate(row_grads)
            u, inverse = np.unique(r, return_inverse=True)
            total = np.zeros((len(u), DIM), np.float32)
            np.add.at(total, inverse, gr)
            table_2[u] += (total**2).mean(axis=1)
            table_[u] -= (0.3 * step * total / np.sqrt(table_2[u])[:, None]).astype(np.float32)
            table_[PAD] = 0
    return model


def _ids(batches):
    for batch in batches:
        data, off = text_buffer(batch.column("text"))
        for i, j in pieces(off):
            ids, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i), batch.column("fold").slice(i, j - i), pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "y", "fold", "ids"])


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _known(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int) -> list[tuple]:
    """(y, fold, ids, doc_id) of the rows to learn from, within both bounds."""
    bound_arrow(docs.sparkSession)
    sample = _known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int"))
    # fit_rows bounds what is broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "fold", "text")
    schema = rows.select("doc_id", "y", "fold", F.col("text").cast("binary").alias("ids")).schema
    # ids that repeat with other texts give more rows than fit_rows: the order tells them apart
    ids = written(rows.mapInArrow(_ids, schema).where(F.length("ids") <= fit_bytes // 16), "learn")
    got, used = [], 0
    for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids"), "ids").toLocalIterator():
        if len(got) == fit_rows:
            break
        if used + len(r.ids) <= fit_bytes:
            used += len(r.ids)
            got.append((r.y, r.fold, bytes(r.ids), r.doc_id))
    return sorted(got, key=lambda r: (r[1], r[0], len(r[2]), r[2]))


def _weights(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int) -> tuple[Model | None, list]:
    """A model without thresholds, and the doc_ids it has learnt from."""
    got = _sample(docs, labels, fit_rows, fit_bytes)
    y = np.array([r[0] for r in got])
    if not len(y) or y.min() == y.max():
        return None, []
    learnt = np.array([r[1] for r in got]) != 0
    if (y[learnt] == 1).sum() < 10 or (y[learnt] == 0).sum() < 10:
        learnt[:] = True
    model = train([np.frombuffer(r[2], np.int32).reshape(-1, 3) for r in got], y, learnt)
    return model, sorted({r[3] for r, own in zip(got, learnt, strict=True) if own})


def _calibrate(model: Model, logits: DataFrame, labels: DataFrame, learnt: list) -> None:
    """Set the thresholds from (doc_id, lang, logit) of all rows."""
    known = _known(labels)
    # at most fit_rows ids
    ids = logits.sparkSession.createDataFrame([(i,) for i in learnt], known.select("doc_id").schema).withColumn("learnt", F.lit(1))
    rows = logits.join(known, "doc_id").join(F.broadcast(ids), "doc_id", "left")
    at = F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("logit") / SPAN)) + 1) / 2 * BINS)
    bins = rows.groupBy(F.coalesce("learnt", F.lit(0)), "lang", at).agg(F.min("logit"), F.max("logit"), F.count("*"), F.sum("y")).collect()
    model.thresholds = thresholds(np.array([tuple(r) for r in bins], float))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, fit_bytes: int = FIT_BYTES) -> Model | None:
    """fit_rows and fit_bytes bound what the weights are learnt from; thresholds are
    set from all labelled rows that are not held out."""
    model, learnt = _weights(docs, labels, fit_rows, fit_bytes)
    if model is not None:
        _calibrate(model, text_logits(docs, model), labels, learnt)
    return model


def text_logits(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, logit) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: the hashed table

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for i, j in pieces(off, 2 << 20):
                ids, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(languages(ids, first).astype(np.int32)), pa.array(m.logits(ids, first).astype(np.float64))], ["doc_id", "lang", "logit"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).alias("lang"), F.lit(0.0).alias("logit")).schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: the hashed table

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for i, j in pieces(off, 2 << 20):
                s = m.scores(*terms(data[off[i] : off[j]], off[i : j + 1] - off[i])) if m is not None else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """docs with a score column, all columns kept; texts don't move."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text):
        column = pa.array(text.fillna(""), pa.string())
        data, off = text_buffer(column)
        m = shared.value
        if m is None:
            return text.map(lambda _: 0.0)
        parts = [m.scores(*terms(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in pieces(off, 2 << 20)]
        import pandas as pd

        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, scored(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the texts that score ``least`` or more; all columns kept."""
    model = fit(docs, labels)
    name = fresh(docs, "__toxicity")
    return with_score(docs, model, name).where(F.col(name) < least).drop(name)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, score) of each row of docs: ``fit`` and ``score`` with one scoring pass."""
    model, learnt = _weights(docs, labels, fit_rows, fit_bytes)
    if model is None:
        return score(docs, model)
    logits = written(text_logits(docs, model), "logits")
    _calibrate(model, logits, labels, learnt)
    own = F.array(*[F.lit(float(t)) for t in model.thresholds])[F.col("lang")]
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") - own))
    return logits.select(F.col("doc_id").cast("long").alias("doc_id"), (1 / (1 + F.exp(-x))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: toxicity of all documents."""
    scores = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
