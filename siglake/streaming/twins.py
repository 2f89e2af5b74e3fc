"""Streaming forms: windows of event time, sessions, and recursions whose state is kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_statistics(events: DataFrame, size: str = "1 hour", hop: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of each user's values; events come with event_time."""
    window = F.window("ts", size, hop) if hop else F.window("ts", size)
    return events.groupBy(window.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("value").alias("peak")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "rms", "peak")


def sessions(events: DataFrame, threshold: float, gap: str = "30 minutes") -> DataFrame:
    """Sessions of values from a threshold on."""
    high = events.where(F.abs("value") >= threshold)
    return high.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def kalman(events: DataFrame, process: float = 1e-5, measurement: float = 1e-2, error: float = 1.0) -> DataFrame:
    """Estimates of each user's level; in a batch, in order of time; the state is the estimate and its error."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (None, error)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, v in zip(rows["event_id"], rows["value"], strict=True):
            x = v if x is None else x
            p += process
            k = p / (p + measurement)
            x += k * (v - x)
            p *= 1 - k
            out.append((key[0], event_id, x))
        state.update((float(x), float(p)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "estimate"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, estimate double", "x double, p double", "append", GroupStateTimeout.NoTimeout)
