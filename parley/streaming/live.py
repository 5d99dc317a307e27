"""Structured Streaming over live events: windows, sessions, a running mean, and idempotent stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, or below the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events; ts becomes a timestamp, as watermarks need one."""
    schema = spark.read.parquet(path).schema
    # A pattern, as a stream's path may be a folder or match files, but not be one file.
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """start, event_type, n, value: counts and sums of tumbling windows; events later than `late` are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that end after `gap` without an event. In append mode a session comes when the
    watermark has passed it, in complete mode those that are still open come too."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_mean(events: DataFrame, alpha: float = 0.35) -> DataFrame:
    """user_id, n, ema: an exponential mean of each user's values, carried in state from batch to batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for value in rows["value"]:
            ema = float(value) if ema is None else alpha * float(value) + (1 - alpha) * ema
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [ema]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def throttled_progress(reports: DataFrame, seconds: float = 1.5, points: float = 2.0) -> DataFrame:
    """reports (call_id, stage, at in seconds, pct) -> those that are passed on: pct, cut to 0-100, is 100, or the last
    one passed on is `seconds` old or differs by `points` at least. What was passed on last is state, from batch to
    batch; reports of a batch are taken in order of time. Reports without a time or pct are left out."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last_pct = state.get if state.exists else (0.0, -1.0)
        kept = []
        for at, pct in pd.concat(list(batches)).sort_values(["at", "pct"])[["at", "pct"]].itertuples(index=False):
            pct = min(100.0, max(0.0, pct))
            if pct >= 100 or at - last_at >= seconds or abs(pct - last_pct) >= points:
                last_at, last_pct = at, pct
                kept.append((*key, at, round(pct, 1)))
        state.update((last_at, last_pct))
        yield pd.DataFrame(kept, columns=["call_id", "stage", "at", "pct"])

    rows = reports.where("at is not null and pct is not null and not isnan(pct)")
    return rows.groupBy("call_id", "stage").applyInPandasWithState(update, "call_id long, stage string, at double, pct double", "at double, pct double", "append", GroupStateTimeout.NoTimeout)


def run_batches(stream: DataFrame, stage: Callable[[DataFrame, int], Any], checkpoint: str, mode: str = "append") -> None:
    """All that is there, batch by batch; a batch that runs again after a failure has its number again, so a stage that
    replaces what it wrote under that number is idempotent."""
    stream.writeStream.foreachBatch(stage).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def into_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's rows, written by batch number and read back. In complete mode each batch holds the whole result, so
    the newest one is read only."""
    out, schema = shared_folder(spark, name), stream.schema

    def stage(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, stage, shared_folder(spark, f"{name}-offsets"), mode)
    rows = spark.read.schema(schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        newest = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(newest))
    return rows


def open_windows(state: DataFrame) -> DataFrame:
    """The rows of windows() that its state still holds."""
    return state.select(F.col("key.window.start").alias("start"), F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n"), F.col("value.sum").alias("value"))


def open_sessions(state: DataFrame) -> DataFrame:
    """The rows of sessions() that its state still holds."""
    return state.select(F.col("key.user_id").alias("user_id"), F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"), F.col("value.count").alias("n"))


def with_open(spark: SparkSession, stream: DataFrame, name: str, of_state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stream's rows in append mode, each written once, when the watermark has passed it; then those that are still open
    at the end, read from the state. The state holds what is not older than the watermark, however long the stream is."""
    out, offsets = shared_folder(spark, name), shared_folder(spark, f"{name}-offsets")

    def stage(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, stage, offsets)
    closed = spark.read.schema(stream.schema.add("batch", "long")).parquet(out).drop("batch")
    return closed.unionByName(of_state(spark.read.format("statestore").load(offsets)))
