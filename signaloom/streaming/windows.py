"""Streams of events: windows with watermarks, sessions, and a causal filter whose delays are its state. Every function takes a streaming or a batch frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """ts as a timestamp with a watermark."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(df: DataFrame, size: str) -> DataFrame:
    out = df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, size: str, step: str) -> DataFrame:
    return df.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(df: DataFrame, gap: str) -> DataFrame:
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _smooth(x: np.ndarray, share: float, last: float | None) -> np.ndarray:
    y = np.empty(len(x))
    for i, v in enumerate(x):
        last = v if last is None else last + share * (v - last)
        y[i] = last
    return y


def causal_batch(df: DataFrame, share: float) -> DataFrame:
    """First-order recursive low-pass per user, in the order of time."""
    cols = df.select("user_id", "event_id", "ts", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pdf[["user_id", "event_id"]].assign(y=_smooth(pdf.value.to_numpy(), share, None))

    return cols.groupBy("user_id").applyInPandas(run, "user_id long, event_id long, y double")


def causal_stream(df: DataFrame, share: float) -> DataFrame:
    """The same on a stream: the state of a user is the last output."""

    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        y = _smooth(pdf.value.to_numpy(), share, last)
        state.update((float(y[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf.event_id.to_numpy(), "y": y})

    return df.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, y double", "last double", "append", "NoTimeout")
