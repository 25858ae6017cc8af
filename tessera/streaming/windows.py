"""Streams of events: windows with late data, sessions, repeats, and keyed state.

Every function takes a streaming (or, for tests and backfills, a batch) DataFrame and
returns one of the same sort; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import new_path
from tessera.sources.drive import is_folder


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files in a folder, or a single one, as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, at: str, length: str, late: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates by windows that follow each other."""
    return _windowed(events, at, late, F.window(at, length), keys, aggs)


def sliding(events: DataFrame, at: str, length: str, slide: str, late: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates by windows that overlap."""
    return _windowed(events, at, late, F.window(at, length, slide), keys, aggs)


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates by runs of events with no longer pause than ``gap``."""
    return _windowed(events, at, late, F.session_window(at, gap), keys, aggs)


def _windowed(events: DataFrame, at: str, late: str, window: Column, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Windows of local stamps are local again; a watermark needs an instant."""
    kind = events.schema[at].dataType
    grouped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(window.alias("__w"), *keys).agg(*aggs)
    rest = [c for c in grouped.columns if c != "__w" and c not in keys]
    return grouped.select(F.col("__w.start").cast(kind).alias("start"), F.col("__w.end").cast(kind).alias("end"), *keys, *rest)


def without_repeats(events: DataFrame, at: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first event of each key; repeats within the watermark go."""
    marked = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def counted(events: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed state in user code: after each micro-batch, every key that was seen with
    its number of events and their sum so far.  (key: long, value: double)"""

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [key_[0]], "n": [n], "total": [total]})

    own = events.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))
    return own.groupBy("key").applyInPandasWithState(step, "key long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def finished(events: DataFrame, at: str, key: str, value: str, late: str, gap_ms: int) -> DataFrame:
    """Keyed state with a timeout in event time: each key's number of events and sum, once the
    watermark has passed its last event by ``gap_ms``; then its state goes, and a later event
    begins anew.  (key: long, n: long, total: double)"""

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [key_[0]], "n": [n], "total": [total]})
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
            last = max(last, int(b["ms"].max()))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    stamp = F.col(at).cast("timestamp")
    own = events.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"), stamp.alias("at"), F.unix_millis(stamp).alias("ms")).withWatermark("at", late)
    return own.groupBy("key").applyInPandasWithState(step, "key long, n long, total double", "n long, total double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it gave.  Rows go to
    Parquet in the shared folder; with mode ``update`` each micro-batch adds its rows."""
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream"), new_path(spark, "offsets")
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    else:
        # a batch that is run again after a failure replaces its own folder
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    writer.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.option("basePath", out).parquet(out).drop("batch")
