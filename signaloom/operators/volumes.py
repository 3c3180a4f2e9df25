"""Volumes as long tables x, y, z, v. Neighbourhood operators send each voxel to its neighbours and aggregate: one shuffle, no self-join.

A neighbourhood is a list of offsets; `z` is a stack of slices and is only crossed when an offset says so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

XYZ = ["x", "y", "z"]
CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)]
SIX = [*CROSS, (0, 0, 1), (0, 0, -1)]
EIGHTEEN = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) <= 2]
TWENTY_SIX = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def neighbourhood(df: DataFrame, offsets, *aggregates: Column) -> DataFrame:
    """x, y, z and aggregates over the existing voxels at the offsets. `v` is a neighbour's value, `w` its squared distance, `own` the voxel's value (null elsewhere)."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), o)], F.lit(float(sum(x * x for x in o))).alias("w")) for o in offsets])
    sent = df.withColumn("o", F.explode(steps)).select((F.col("x") - F.col("o.a")).alias("x"), (F.col("y") - F.col("o.b")).alias("y"), (F.col("z") - F.col("o.c")).alias("z"), "v", F.col("o.w").alias("w"), F.when(F.col("o.w") == 0, F.col("v")).alias("own"))
    return sent.groupBy(*XYZ).agg(F.max("own").alias("_own"), *aggregates).filter("_own is not null").drop("_own")


def erode(df, offsets=CROSS):
    return neighbourhood(df, offsets, F.min("v").alias("v"))


def dilate(df, offsets=CROSS):
    return neighbourhood(df, offsets, F.max("v").alias("v"))


def opened(df, offsets=CROSS):
    return dilate(erode(df, offsets), offsets)


def closed(df, offsets=CROSS):
    return erode(dilate(df, offsets), offsets)


def gradient(df, offsets=CROSS, kind: str = "both"):
    """Dilated less eroded; `inner`: own less eroded; `outer`: dilated less own."""
    value = {"both": F.max("v") - F.min("v"), "inner": F.max("own") - F.min("v"), "outer": F.max("v") - F.max("own")}[kind]
    return neighbourhood(df, offsets, value.alias("v"))


def mean(df, offsets=CROSS):
    return neighbourhood(df, offsets, F.avg("v").alias("v"))


def median(df, offsets=CROSS):
    return neighbourhood(df, offsets, F.percentile("v", F.lit(0.5)).alias("v"))


def gaussian(df, sigma: float = 1.0, offsets=CROSS):
    weight = F.exp(-F.col("w") / (2 * sigma * sigma))
    return neighbourhood(df, offsets, (F.sum(weight * F.col("v")) / F.sum(weight)).alias("v"))


def dispersion(df, offsets=CROSS):
    """sd, cov, snr (mean over sd), range, low, high, mad (about the median), skewness, excess kurtosis, and the value less the mean, over it, less the median."""
    near = F.collect_list("v")  # as many as there are offsets
    out = neighbourhood(df, offsets, near.alias("_a"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("sd"), F.median("v").alias("_d"), F.min("v").alias("low"), F.max("v").alias("high"), F.max("own").alias("_o"))
    mean, sd, middle, own = F.col("_m"), F.nullif("sd", F.lit(0.0)), F.col("_d"), F.col("_o")
    power = lambda n: F.aggregate(F.transform("_a", lambda x: F.pow((x - mean) / sd, F.lit(n))), F.lit(0.0), lambda a, b: a + b) / F.size("_a")
    away = F.array_sort(F.transform("_a", lambda x: F.abs(x - middle)))
    n = F.size("_a")
    half = (F.element_at(away, F.floor((n + 1) / 2).cast("int")) + F.element_at(away, F.floor((n + 2) / 2).cast("int"))) / 2
    return out.select(
        *XYZ, "sd", (F.col("sd") / F.nullif(F.abs(mean), F.lit(0.0))).alias("cov"), (mean / sd).alias("snr"), (F.col("high") - F.col("low")).alias("range"), "low", "high", half.alias("mad"),
        power(3).alias("skewness"), (power(4) - 3).alias("kurtosis"), (own - mean).alias("less_mean"), (own / F.nullif(mean, F.lit(0.0))).alias("over_mean"), (own - middle).alias("less_median"),
    )


def laplacian(df, axes=("x", "y")):
    """Second differences; at an edge, of the neighbours that exist."""
    offsets = [(0, 0, 0)] + [tuple(s * (a == n) for a in XYZ) for n in axes for s in (1, -1)]
    return neighbourhood(df, offsets, (F.sum("v") - F.count("*") * F.max("own")).alias("v"))


def hessian(df) -> DataFrame:
    """low, high: eigenvalues of the in-plane Hessian, in closed form, where all eight neighbours exist."""
    offsets = [(a, b, 0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in offsets])
    sent = df.withColumn("o", F.explode(steps)).select((F.col("x") - F.col("o.a")).alias("x"), (F.col("y") - F.col("o.b")).alias("y"), "z", "v", F.col("o.a").alias("a"), F.col("o.b").alias("b"))
    at = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("v")))
    h = sent.groupBy(*XYZ).agg(F.count("*").alias("n"), (at(1, 0) + at(-1, 0) - 2 * at(0, 0)).alias("xx"), (at(0, 1) + at(0, -1) - 2 * at(0, 0)).alias("yy"), ((at(1, 1) + at(-1, -1) - at(1, -1) - at(-1, 1)) / 4).alias("xy")).filter("n = 9")
    mid, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", 2))
    return h.select(*XYZ, (mid - root).alias("low"), (mid + root).alias("high"))


def entropy(df, bins: int, low: float, high: float, offsets=CROSS):
    """Entropy and most frequent value (the lowest on a tie) of quantised neighbours."""
    q = df.withColumn("v", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / (high - low) * bins))).cast("double"))
    counts = [F.sum(F.when(F.col("v") == k, 1.0).otherwise(0.0)) for k in range(bins)]
    n = F.count("*")
    ent = sum((F.when(c > 0, -(c / n) * F.ln(c / n)).otherwise(F.lit(0.0)) for c in counts), F.lit(0.0))
    return neighbourhood(q, offsets, ent.alias("entropy"), F.mode("v", True).alias("mode"))


def sharpen(df, offsets=CROSS):
    """The nearer of the neighbourhood's minimum and maximum; the minimum on a tie."""
    own = F.max("own")
    return neighbourhood(df, offsets, F.when(own - F.min("v") <= F.max("v") - own, F.min("v")).otherwise(F.max("v")).alias("v"))


def count_rule(df, least: int, offsets=CROSS, add: bool = False):
    """Of a binary volume, drops voxels with fewer than `least` set neighbours, or adds those with as many."""
    n, own = F.sum("v") - F.max("own"), F.max("own")
    return neighbourhood(df, offsets, (F.when((own > 0) | (n >= least), 1.0) if add else F.when((own > 0) & (n >= least), 1.0)).otherwise(F.lit(0.0)).alias("v"))


def fullness(df, offsets=CROSS):
    return neighbourhood(df, offsets, F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("v"))


def binarise(df, level: float = 0.0):
    return df.withColumn("v", F.when(F.col("v") > level, 1.0).otherwise(0.0))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Masks: apply (and), remove (minus), fill (times), merge (or), difference (xor), insert (b where it is set). One union and aggregation instead of a join."""
    both = a.select(*XYZ, F.col("v").alias("p"), F.lit(None).cast("double").alias("q")).unionByName(b.select(*XYZ, F.lit(None).cast("double").alias("p"), F.col("v").alias("q")))
    p, q = F.coalesce(F.max("p"), F.lit(0.0)), F.coalesce(F.max("q"), F.lit(0.0))
    rule = {
        "apply": F.when(q > 0, p).otherwise(F.lit(0.0)), "remove": F.when(q > 0, F.lit(0.0)).otherwise(p), "fill": p * q, "merge": F.greatest(p, q), "difference": F.when((p > 0) != (q > 0), F.lit(1.0)).otherwise(F.lit(0.0)), "insert": F.when(q > 0, q).otherwise(p),
    }[how]
    return both.groupBy(*XYZ).agg(rule.alias("v"))


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, size - 1 - F.col(axis))


def symmetrise(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.unionByName(flip(df, axis, size)).groupBy(*XYZ).agg(F.max("v").alias("v"))


def template_brain(df: DataFrame, keys=("x", "y", "z")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("v").alias("v"))


def tissues(masks: list[DataFrame]) -> DataFrame:
    """Masks into one volume of codes 1, 2, ...; the later mask has priority."""
    out = None
    for n, m in enumerate(masks, 1):
        one = m.filter("v > 0").select(*XYZ, F.lit(float(n)).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*XYZ).agg(F.max("v").alias("v"))


def regions(df: DataFrame, offsets=CROSS) -> DataFrame:
    """x, y, z, region of the set voxels: the smallest voxel (z, y, x as a struct, so coordinates of any size) that each reaches. Components of the graph of neighbours, by star contractions: few rounds whatever a region's length."""
    voxel = F.struct(*[F.col(c).alias(c) for c in ("z", "y", "x")])
    on = df.filter("v > 0").select(*XYZ)
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), o)]) for o in offsets if o > (0, 0, 0)])  # each pair once
    near = on.withColumn("a", voxel).withColumn("o", F.explode(steps)).select("a", *[(F.col(c) + F.col(f"o.{n}")).alias(c) for c, n in zip(XYZ, "abc")])
    edges = near.join(on.withColumn("b", voxel), XYZ).select("a", "b")
    found = components(edges).select(*[F.col(f"node.{c}").alias(c) for c in XYZ], F.col("root").alias("region"))
    return on.join(found, XYZ, "left").withColumn("region", F.coalesce("region", voxel))


def biggest(found: DataFrame, n: int = 1, by=("z",)) -> DataFrame:
    """The largest regions of each slice; the smaller number on a tie."""
    from pyspark.sql import Window as W

    sizes = found.groupBy(*by, "region").agg(F.count("*").alias("n"))
    keep = sizes.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), "region"))).filter(F.col("r") <= n).select(*by, "region")
    return found.join(keep, [*by, "region"], "left_semi")


def most_compact(found: DataFrame, n: int = 1, least: int = 1) -> DataFrame:
    """z, region, n, inside: of each slice the n most compact regions of at least `least` voxels; the larger one on a tie, then the first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("z").orderBy(F.round("inside", 9).desc(), F.col("n").desc(), "region")
    kept = found.filter(F.col("n") >= least).withColumn("z", F.col("region.z"))
    return kept.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def histogram(df: DataFrame, low: float, high: float, bins: int, by=("z",)) -> DataFrame:
    """by, bin, n: counts of values in equal bins; values outside fall into the first or last."""
    place = F.floor((F.col("v") - low) / ((high - low) / bins))
    return df.groupBy(*by, F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def with_volume(a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, z, added, subtracted, multiplied, divided: two volumes voxel by voxel, where both have the voxel."""
    both = a.select(*XYZ, "v").join(b.select(*XYZ, F.col("v").alias("w")), XYZ)
    v, w = F.col("v"), F.col("w")
    return both.select(*XYZ, (v + w).alias("added"), (v - w).alias("subtracted"), (v * w).alias("multiplied"), (v / F.nullif(w, F.lit(0.0))).alias("divided"))


def gaussian_by_axis(df: DataFrame, sigmas, offsets=None) -> DataFrame:
    """Gaussian mean with a width of its own for each axis; over the 3 by 3 neighbours of a slice unless told otherwise."""
    offsets = offsets or [(a, b, 0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    weight = lambda o: math.exp(-sum(x * x / (2 * s * s) for x, s in zip(o, sigmas)))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)], F.lit(weight(o)).alias("w"), F.lit(o == (0, 0, 0)).alias("own")) for o in offsets])
    sent = df.withColumn("o", F.explode(steps)).select(*[(F.col(c) - F.col(f"o.{n}")).alias(c) for c, n in zip(XYZ, "abc")], (F.col("v") * F.col("o.w")).alias("v"), F.col("o.w").alias("w"), F.col("o.own").alias("own"))
    return sent.groupBy(*XYZ).agg(F.max("own").alias("_own"), (F.sum("v") / F.sum("w")).alias("v")).filter("_own").drop("_own")


def compactness(found: DataFrame, offsets=CROSS) -> DataFrame:
    """region, n, inside (share of neighbour places that belong to the region)."""
    full = neighbourhood(found.withColumn("v", F.lit(1.0)), offsets, F.count("*").alias("near"), F.max("own").alias("v"))
    return full.join(found, XYZ).groupBy("region").agg(F.count("*").alias("n"), (F.sum("near") / (F.count("*") * len(offsets))).alias("inside"))


def tissue_levels(histogram: list[tuple[float, int]], classes: int = 3, rounds: int = 100) -> list[float]:
    """Cut points between grey-level classes: one-dimensional k-means on a histogram (a row per bin)."""
    x, n = np.array([h[0] for h in histogram], float), np.array([h[1] for h in histogram], float)
    centre = x.min() + (np.arange(classes) + 0.5) / classes * (x.max() - x.min())
    for _ in range(rounds):
        lab = np.abs(x[:, None] - centre[None, :]).argmin(1)
        new = np.array([np.average(x[lab == k], weights=n[lab == k]) if (lab == k).any() else centre[k] for k in range(classes)])
        if np.allclose(new, centre):
            break
        centre = new
    centre = np.sort(centre)
    return ((centre[1:] + centre[:-1]) / 2).tolist()


def classify(df: DataFrame, cuts: list[float]) -> DataFrame:
    out = F.lit(1)
    for c in cuts:
        out = out + F.when(F.col("v") > c, 1).otherwise(0)
    return df.withColumn("tissue", out.cast("int"))


def bias_field(df: DataFrame, block: int = 4) -> DataFrame:
    """v over the mean of its block: a low-pass of the intensity, divided out."""
    b = [F.floor(F.col(a) / block).alias(f"b{a}") for a in ("x", "y")]
    low = df.groupBy(*b, "z").agg(F.avg("v").alias("low"))
    keyed = df.select("*", *b)
    return keyed.join(low, ["bx", "by", "z"]).select(*XYZ, (F.col("v") / F.nullif("low", F.lit(0.0))).alias("v"))


def resample(df: DataFrame, ratio: int) -> DataFrame:
    """Blocks of ratio^2 voxels of a slice averaged: the inverse of an isotropic enlargement."""
    return df.groupBy(F.floor(F.col("x") / ratio).cast("int").alias("x"), F.floor(F.col("y") / ratio).cast("int").alias("y"), "z").agg(F.avg("v").alias("v"))


def talairach(x: Column, y: Column, z: Column) -> list[Column]:
    """MNI to Talairach coordinates, the piecewise affine map published by M. Brett."""
    up = z >= 0
    rows = ((0.99, 0, 0), (0, 0.9688, (0.046, 0.042)), (0, (-0.0485, -0.0485), (0.9189, 0.839)))
    pick = lambda c: F.when(up, F.lit(float(c[0]))).otherwise(F.lit(float(c[1]))) if isinstance(c, tuple) else F.lit(float(c))
    return [pick(r[0]) * x + pick(r[1]) * y + pick(r[2]) * z for r in rows]


def isosurface_area(df: DataFrame, level: float, axes=("x", "y")) -> DataFrame:
    """z, faces: voxel faces between inside and outside in each slice, a blocky isosurface's size."""
    inside = df.withColumn("v", F.when(F.col("v") > level, 1.0).otherwise(0.0))
    parts = None
    for n in axes:
        offsets = [(0, 0, 0), tuple(int(a == n) for a in XYZ)]
        one = neighbourhood(inside, offsets, (F.max("v") - F.min("v")).alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("z").agg(F.sum("v").alias("faces"))


def objective(a: DataFrame, b: DataFrame, shift: tuple[int, int, int]) -> float:
    """Correlation of two volumes under a shift: the objective of a registration, aggregated in Spark."""
    moved = b.select((F.col("x") + shift[0]).alias("x"), (F.col("y") + shift[1]).alias("y"), (F.col("z") + shift[2]).alias("z"), F.col("v").alias("w"))
    return a.join(moved, XYZ).agg(F.corr("v", "w")).first()[0] or -math.inf


def coregister(a: DataFrame, b: DataFrame, most: int = 2) -> tuple[int, int]:
    """The in-plane shift of b with the best objective, by descent over neighbours on the driver; volumes stay distributed."""
    at, best = (0, 0), objective(a, b, (0, 0, 0))
    for _ in range(2 * most):
        tried = {(at[0] + i, at[1] + j): objective(a, b, (at[0] + i, at[1] + j, 0)) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)) if max(abs(at[0] + i), abs(at[1] + j)) <= most}
        step = max(tried, key=tried.get, default=None)
        if step is None or tried[step] <= best:
            return at
        at, best = step, tried[step]
    return at


def thin(df: DataFrame, by: str = "z") -> DataFrame:
    """Skeleton of each binary slice (Zhang and Suen 1984), a slice at a time through Arrow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        img = np.zeros((y.max() + 3, x.max() + 3), int)
        img[y + 1, x + 1] = pdf.v.to_numpy() > 0
        while True:
            before = img.copy()
            for phase in (0, 1):
                p = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
                turns, count = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8)), sum(p)
                one, two = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if phase == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
                img = img & ~((img == 1) & (turns == 1) & (count >= 2) & (count <= 6) & (one == 0) & (two == 0))
            if (img == before).all():
                return pdf.assign(v=img[y + 1, x + 1].astype(float))

    cols = df.select(*XYZ, "v")
    return cols.groupBy(by).applyInPandas(run, cols.schema)


def strip(df: DataFrame, level: float) -> DataFrame:
    """Skull stripping in its simplest form: threshold, opening, the biggest region of each slice, dilation, mask."""
    kept = biggest(regions(opened(binarise(df, level))))
    grown = dilate(combine(df.withColumn("v", F.lit(0.0)), kept.select(*XYZ, F.lit(1.0).alias("v")), "merge"))
    return combine(df, grown, "apply")
