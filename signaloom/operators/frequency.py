"""Spectra of sliding windows. Windows are rows rec, win, track and an array of samples x; spectra are rec, win, track, f, re, im, power."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(df: DataFrame, size: int, step: int, by=("rec", "track")) -> DataFrame:
    """by, win, i, value: every sample in each of the size/step windows that it belongs to; incomplete windows are dropped. A shuffle on the window, none on the recording."""
    first = F.greatest(F.lit(0), F.ceil((F.col("tf") - size + 1) / step)).cast("long")
    spread = df.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("tf") / step).cast("long"))))
    return spread.select(*by, "win", (F.col("tf") - F.col("win") * step).cast("int").alias("i"), "value")


def complete(win: DataFrame, size: int, by=("rec", "track")) -> DataFrame:
    """by, win, x: the samples of each complete window, in order."""
    out = win.groupBy(*by, "win").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"))  # at most `size` samples a row
    return out.filter(F.size("s") == size).select(*by, "win", F.transform("s", lambda p: p["value"]).alias("x"))


def hanning(x, size: int):
    return F.transform(x, lambda v, i: v * (0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1))))


def dft(win: DataFrame, size: int, frequencies, rescale: str = "none", by=("rec", "track")) -> DataFrame:
    """by, win, f, re, im, power at whole frequency numbers f (cycles a window), in the JVM. rescale: none, n (divided by size) or parseval (by its root)."""
    k = {"none": 1.0, "n": 1.0 / size, "parseval": 1.0 / math.sqrt(size)}[rescale]
    part = lambda g: F.aggregate(F.transform("x", lambda v, i: v * g(F.lit(2 * math.pi / size) * ((F.col("f") * i) % size))), F.lit(0.0), lambda a, b: a + b) * k
    out = win.withColumn("f", F.explode(F.array(*[F.lit(int(f)) for f in frequencies])))
    out = out.select(*by, "win", "f", part(F.cos).alias("re"), (-part(F.sin)).alias("im"))
    return out.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def fft(win: DataFrame, size: int, by=("rec", "track")) -> DataFrame:
    """The whole spectrum by a fast transform, on Arrow batches of windows."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            z = np.fft.rfft(np.stack(b.x.to_numpy()), axis=1)
            rep = b.loc[b.index.repeat(z.shape[1]), [*by, "win"]].reset_index(drop=True)
            yield rep.assign(f=np.tile(np.arange(z.shape[1]), len(b)), re=z.real.ravel(), im=z.imag.ravel(), power=(np.abs(z) ** 2).ravel())

    kinds = dict(win.dtypes)
    return win.select(*by, "win", "x").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", win long, f int, re double, im double, power double")


def bands(spectrum: DataFrame, text: str, by=("rec", "win", "track")) -> DataFrame:
    """Mean power of bands such as `4-8; 8-14; 20-40`; a frequency may be in several."""
    pairs = [tuple(float(x) for x in p.split("-")) for p in text.split(";")]
    rows = F.array(*[F.struct(F.lit(f"{a:g}-{b:g}").alias("band"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    inside = spectrum.withColumn("m", F.explode(F.filter(rows, lambda r: F.col("f").between(r["a"], r["b"]))))
    return inside.groupBy(*by, F.col("m.band").alias("band")).agg(F.avg("power").alias("power"))


def log_grid(per_decade: int, low: float, high: float) -> list[float]:
    first, last = math.ceil(math.log10(low) * per_decade - 1e-9), math.floor(math.log10(high) * per_decade + 1e-9)
    return [10 ** (k / per_decade) for k in range(first, last + 1)]


def normalised(spectrum: DataFrame, by=("rec", "win", "track")) -> DataFrame:
    sums = spectrum.groupBy(*by).agg(F.sum("power").alias("total"))
    return spectrum.join(sums, list(by)).withColumn("power", F.col("power") / F.nullif("total", F.lit(0.0))).drop("total")


def coherence(a: DataFrame, b: DataFrame, keys=("rec", "win"), out=("f",)) -> DataFrame:
    """Squared magnitude of the summed cross-spectrum over the product of the summed powers."""
    j = a.select(*keys, "f", F.col("re").alias("ar"), F.col("im").alias("ai")).join(b.select(*keys, "f", F.col("re").alias("br"), F.col("im").alias("bi")), [*keys, "f"])
    cross = j.groupBy(*out).agg(
        F.sum(F.expr("ar * br + ai * bi")).alias("cr"), F.sum(F.expr("ai * br - ar * bi")).alias("ci"), F.sum(F.expr("ar * ar + ai * ai")).alias("pa"), F.sum(F.expr("br * br + bi * bi")).alias("pb")
    )
    return cross.select(*out, (F.expr("cr * cr + ci * ci") / F.nullif(F.col("pa") * F.col("pb"), F.lit(0.0))).alias("coherence"))


def s_transform(df: DataFrame, frequencies: list[int], by=("rec", "track")) -> DataFrame:
    """Stockwell transform of each track: by, tf, f, re, im. One recording's track at a time, through Arrow."""
    kinds = dict(df.dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("tf").value.to_numpy(float)
        n, spectrum, out = len(x), np.fft.fft(x), []
        m = np.fft.fftfreq(n) * n
        for f in frequencies:
            if f >= n:
                continue
            z = np.full(n, x.mean(), complex) if f == 0 else np.fft.ifft(np.roll(spectrum, -f) * np.exp(-2 * np.pi**2 * m**2 / f**2))
            out.append(pd.DataFrame({**{c: k for c, k in zip(by, key)}, "tf": np.arange(n), "f": f, "re": z.real, "im": z.imag}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*by, "tf", "f", "re", "im"])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", tf long, f int, re double, im double")


def split_by(spectrum: DataFrame, path: str, key: str) -> None:
    """A folder per frequency, electrode or window."""
    spectrum.write.partitionBy(key).parquet(path)


def merge(tracks: dict[float, DataFrame]) -> DataFrame:
    """Tracks of several frequencies into one table with f."""
    out = None
    for f, df in tracks.items():
        one = df.withColumn("f", F.lit(float(f)))
        out = one if out is None else out.unionByName(one)
    return out
