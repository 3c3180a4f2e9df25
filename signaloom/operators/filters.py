"""Recursive filters, a track at a time through Arrow: a recursion over time has no relational form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(kind: str, order: int, cutoff: float, rate: float) -> np.ndarray:
    """Second-order sections b0 b1 b2 a1 a2 of an even-order Butterworth low-pass or high-pass, by the bilinear transform with pre-warped cut-off."""
    w = math.tan(math.pi * cutoff / rate)
    rows = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * w + w * w
        b = (w * w, 2 * w * w, w * w) if kind == "low" else (1.0, -2.0, 1.0)
        rows.append([*(x / d for x in b), 2 * (w * w - 1) / d, (1 - q * w + w * w) / d])
    return np.array(rows)


def notch(frequency: float, rate: float, quality: float = 30.0) -> np.ndarray:
    w = 2 * math.pi * frequency / rate
    a = math.sin(w) / (2 * quality)
    return np.array([[1 / (1 + a), -2 * math.cos(w) / (1 + a), 1 / (1 + a), -2 * math.cos(w) / (1 + a), (1 - a) / (1 + a)]])


def run_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered samples and the delays after them (transposed direct form II)."""
    state = np.zeros((len(sections), 2)) if state is None else state.copy()
    y = np.asarray(x, float).copy()
    for s, (b0, b1, b2, a1, a2) in enumerate(sections):
        z1, z2 = state[s]
        for i, v in enumerate(y):
            out = b0 * v + z1
            z1 = b1 * v - a1 * out + z2
            z2 = b2 * v - a2 * out
            y[i] = out
        state[s] = z1, z2
    return y, state


def apply(df: DataFrame, sections: np.ndarray, causal: bool = True, by=("rec", "track")) -> DataFrame:
    """value filtered along tf; not causal: forward, then backward."""
    table = sections.tolist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tf")
        y = run_sections(np.array(table), pdf.value.to_numpy())[0]
        if not causal:
            y = run_sections(np.array(table), y[::-1])[0][::-1]
        return pdf.assign(value=y)

    cols = df.select(*by, "tf", "value")
    return cols.groupBy(*by).applyInPandas(run, cols.schema)


def notches(frequency: float, rate: float) -> np.ndarray:
    """A notch at a frequency and all its harmonics below half the sampling rate."""
    return np.concatenate([notch(f, rate) for f in np.arange(frequency, rate / 2, frequency)])


def spatial(df: DataFrame, neighbours: DataFrame, keys=("tf",)) -> DataFrame:
    """Median over each electrode and its neighbours (e, near): a join and an aggregation."""
    near = df.join(neighbours, df["e"] == neighbours["near"]).select(*keys, neighbours["e"], "x")
    return near.groupBy(*keys, "e").agg(F.percentile("x", F.lit(0.5)).alias("x"))
