"""One function per command: recordings in, a DataFrame out. `python -m signaloom.plans.commands` runs them from a shell."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import frequency as FR
from ..operators import geometry as G
from ..operators import source_space as SS
from ..operators import tracks as T
from ..sources import binary, text


def open_tracks(spark: SparkSession, path: str) -> DataFrame:
    """rec, tf, track, value by the extension of the path."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("edf", "bdf"):
        return binary.read_edf(spark, path)
    if ext == "vhdr":
        return binary.read_brainvision(spark, path)
    if ext in ("ep", "eph"):
        return text.read_tracks(spark, path, header=ext == "eph")
    return spark.read.parquet(path)


def reprocess_tracks(
    df: DataFrame, tracks: str | None = None, rois: DataFrame | None = None, first: int | None = None, last: int | None = None, rate: float = 1.0, dc: bool = False, high: float | None = None, low: float | None = None,
    notch: float | None = None, causal: bool = False, ranking: bool = False, reference: str = "none", rectify: bool = False, envelope: int = 0, threshold: tuple[float, float] | None = None,
    baseline: tuple[int, int] | None = None, factor: float = 1.0, ratio: int = 1, average: bool = False,
) -> DataFrame:
    """Tracks or regions, time interval, the sequence of filters (the reference between ranking and rectification), baseline, factor, output time; steps not asked for cost nothing.

    reference: none, average, or a list of tracks such as `1, 2`.
    """
    if tracks:
        df = T.select_tracks(df, T.parse_list(tracks))
    if rois is not None:
        df = df.join(rois.select(F.col("idx").alias("track"), "roi"), "track").groupBy("rec", "tf", F.col("roi").alias("track")).agg(F.avg("value").alias("value"))
    if first is not None or last is not None:
        df = T.interval(df, first or 0, last)
    if dc:
        df = T.remove_dc(df)
    for kind, cut in (("high", high), ("low", low)):
        if cut:
            df = FL.apply(df, FL.butterworth(kind, 2, cut, rate), causal)
    if notch:
        df = FL.apply(df, FL.notches(notch, rate), causal)
    if ranking:
        df = T.rank_filter(df)
    if reference != "none":
        base = df if reference == "average" else T.select_tracks(df, T.parse_list(reference))
        df = df.join(base.groupBy("rec", "tf").agg(F.avg("value").alias("_base")), ["rec", "tf"]).withColumn("value", F.col("value") - F.col("_base")).drop("_base")
    if rectify:
        df = T.rectify(df)
    if envelope:
        df = T.envelope(df, envelope)
    if threshold:
        df = df.withColumn("value", T.threshold("value", *threshold))
    if baseline:
        df = T.baseline(df, *baseline)
    if factor != 1.0:
        df = T.rescale(df, factor)
    if ratio > 1:
        df = T.downsample(df, ratio)
    return T.time_average(df) if average else df


def interpolate_tracks(df: DataFrame, points: np.ndarray, bad: list[int], degree: int = 4) -> DataFrame:
    """Bad tracks replaced by spherical splines of the others; points: electrodes by 3."""
    good = [k for k in range(len(points)) if k not in bad]
    w = G.spline_weights(points[good], points[bad], degree)
    weights = df.sparkSession.createDataFrame([(bad[b], good[g], float(w[b, g])) for b in range(len(bad)) for g in range(len(good))], "to int, track int, w double")
    new = df.join(weights, "track").groupBy("rec", "tf", F.col("to").alias("track")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return T.exclude_tracks(df, bad).select("rec", "tf", "track", "value").unionByName(new)


def frequency_analysis(df: DataFrame, size: int, step: int, hanning: bool = False, average: bool = False, bands: str | None = None) -> DataFrame:
    """Power of sliding windows by a fast transform; of whole frequencies or of bands, in sequence or averaged."""
    win = FR.complete(FR.windows(df, size, step), size)
    out = FR.fft(win.withColumn("x", FR.hanning("x", size)) if hanning else win, size)
    if average:
        out = out.groupBy("rec", "track", "f").agg(F.avg("power").alias("power")).withColumn("win", F.lit(0).cast("long"))
    return FR.bands(out, bands) if bands else out


def computing_ris(df: DataFrame, inverse: DataFrame, kind: str = "norm", zscore: bool = False, keys=("rec", "tf")) -> DataFrame:
    """Inverse solution of every frame; kind: norm or vector. zscore: per solution point over the recording."""
    ris = SS.product(df.select(*keys, F.col("track").alias("e"), F.col("value").alias("x")), inverse, keys)
    if kind == "vector":
        return ris
    out = SS.norm(ris, keys)
    if zscore:
        factors = out.groupBy("rec", "sp").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
        out = out.join(factors, ["rec", "sp"]).select(*keys, "sp", ((F.col("v") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("v"))
    return out


def ris_to_volume(ris: DataFrame, voxels: DataFrame, points: DataFrame, neighbours: int = 4, reach: float = 20.0) -> DataFrame:
    """tf, x, y, z, v: voxels (idx, x, y, z) from their nearest solution points (idx, x, y, z)."""
    places = G.nearest(voxels, points, neighbours, reach).join(voxels, "idx").select("x", "y", "z", F.col("near").alias("sp"), "d")
    return SS.to_volume(ris, places)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="signaloom")
    parser.add_argument("command", choices=["reprocesstracks", "frequencyanalysis"])
    parser.add_argument("--input-dir")
    parser.add_argument("--output-dir")
    parser.add_argument("--tracks")
    parser.add_argument("--reference", default="none")
    for name in ("rate", "high", "low", "notch"):
        parser.add_argument(f"--{name}", type=float)
    for name in ("size", "step"):
        parser.add_argument(f"--{name}", type=int, default=256)
    parser.add_argument("--hanning", action="store_true")
    parser.add_argument("--overwrite", action=argparse.BooleanOptionalAction, default=False)
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("files", nargs="+")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for name in a.files:
        path = text.resolve(name, a.input_dir)
        df = open_tracks(spark, path)
        if a.command == "reprocesstracks":
            out = reprocess_tracks(df, a.tracks, rate=a.rate or 1.0, high=a.high, low=a.low, notch=a.notch, reference=a.reference)
        else:
            out = frequency_analysis(df, a.size, a.step, a.hanning)
        to = text.output_name(text.resolve(name.rsplit("/", 1)[-1] + f".{a.command}.parquet", a.output_dir, create=True), a.overwrite)
        out.write.mode("overwrite" if a.overwrite else "errorifexists").parquet(to)
        if a.verbose:
            text.verbose(to + ".vrb", **vars(a), output=to)


if __name__ == "__main__":
    main()
