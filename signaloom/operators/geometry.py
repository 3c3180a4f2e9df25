"""Points and transforms: sets of electrodes or solution points as set_id, idx, x, y, z."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written

XYZ = ["x", "y", "z"]
#: Targets that are broadcast, with the 27 cubes around each.
FEW = 1_000


def transform(df: DataFrame, m) -> DataFrame:
    """A 4 by 4 transform, folded into one projection."""
    new = [sum((float(m[r][k]) * F.col(a) for k, a in enumerate(XYZ)), F.lit(float(m[r][3]))) for r in range(3)]
    return df.select(*[new[XYZ.index(c)].alias(c) if c in XYZ else c for c in df.columns])


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns])


def distance(a: str, b: str):
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in XYZ), F.lit(0.0)))


def bounding_box(df: DataFrame, by="set_id") -> DataFrame:
    return df.groupBy(by).agg(*[g(c).alias(f"{c}_{n}") for c in XYZ for n, g in (("min", F.min), ("max", F.max))])


def nearest(points: DataFrame, targets: DataFrame, k: int, cell: float) -> DataFrame:
    """idx, near, d: the k nearest targets (all, where there are fewer), the smaller number on a tie. Space is dealt into cubes of size `cell`, so points meet only the 27 cubes around them: an equi-join.

    Points that find fewer than k targets within `cell` ask again with twice the size, until every point has its own; each round is written. Points with a missing coordinate have none. Up to FEW targets, whose
    number is checked, travel to the points; nothing that grows with the points is broadcast.
    """
    left = points.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in XYZ))
    targets = written(targets.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in XYZ)))
    held, out = targets.limit(max(k, FEW + 1)).count(), None
    k = min(k, held)
    while k:
        found = written(_within(left, targets, k, cell, held <= FEW))
        out = found if out is None else out.unionByName(found)
        done = found.select(F.col("idx").alias("done")).distinct()
        left = left.hint("merge").join(done, F.col("idx").eqNullSafe(F.col("done")), "left_anti")
        if left.isEmpty():
            return out
        left, cell = written(left), 2 * cell
    return _within(left, targets, 1, cell, True).limit(0)


def _within(points: DataFrame, targets: DataFrame, k: int, cell: float, few: bool) -> DataFrame:
    """The k nearest targets of the points that have as many within `cell`. Few targets name the 27 cubes around them and are broadcast; else the points do, and both sides are shuffled."""
    at = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in XYZ]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])
    spread = lambda df, *cols: df.withColumn("o", F.explode(around)).select(*cols, *[(F.col(f"c{c}") + F.col(f"o.{i}")).alias(f"c{c}") for c, i in zip(XYZ, "ijm")])
    p, t = points.select("idx", F.struct(*XYZ).alias("p"), *at), targets.select(F.col("idx").alias("near"), F.struct(*XYZ).alias("t"), *at)
    cubes = [f"c{c}" for c in XYZ]
    met = p.join(F.broadcast(spread(t, "near", "t")), cubes) if few else spread(p, "idx", "p").hint("merge").join(t, cubes)
    pairs = met.select("idx", "near", distance("p", "t").alias("d")).filter(F.col("d") <= cell)
    ranked = pairs.withColumn("r", F.row_number().over(W.partitionBy("idx").orderBy(F.round("d", 9), "near"))).filter(F.col("r") <= k)
    return ranked.withColumn("n", F.max("r").over(W.partitionBy("idx"))).filter(F.col("n") == k).drop("r", "n")


def pair_distances(df: DataFrame) -> DataFrame:
    """set_id, a, b, d of all electrodes of a set (up to a few hundred)."""
    a, b = df.select("set_id", F.col("idx").alias("a"), F.struct(*XYZ).alias("p")), df.select("set_id", F.col("idx").alias("b"), F.struct(*XYZ).alias("q"))
    return a.join(b, "set_id").filter("a < b").select("set_id", "a", "b", distance("p", "q").alias("d"))


def spread(df: DataFrame) -> DataFrame:
    """set_id, idx, distance of each electrode to the mean of all sets; one aggregation and a join on the electrode."""
    centre = df.groupBy("idx").agg(F.struct(*[F.avg(c).alias(c) for c in XYZ]).alias("m"))
    return df.withColumn("p", F.struct(*XYZ)).join(centre, "idx").select("set_id", "idx", distance("p", "m").alias("distance"))


def variation(df: DataFrame) -> DataFrame:
    """set_id, average distance, coefficient of variation in per cent; sets over about 52 per cent are unfit."""
    out = spread(df).groupBy("set_id").agg(F.avg("distance").alias("average"), (100 * F.stddev_samp("distance") / F.nullif(F.avg("distance"), F.lit(0.0))).alias("cov"))
    return out.withColumn("unfit", F.col("cov") > 52)


def similarity(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift that take source nearest to target (Umeyama 1991)."""
    a, b = source - source.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(b.T @ a)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ flip @ vt
    k = float((s * np.diag(flip)).sum() / max((a**2).sum(), 1e-300))
    return k, r, target.mean(0) - k * r @ source.mean(0)


def _fitted_to(target: np.ndarray):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        p = pdf[XYZ].to_numpy(float)
        k, r, shift = similarity(p, target)
        pdf[XYZ] = k * p @ r.T + shift
        return pdf

    return fit


def template(df: DataFrame, repetitions: int = 3) -> DataFrame:
    """idx, x, y, z: sets fitted to their running mean by 7 parameters and averaged, `repetitions` times. Sets are fitted in parallel; the template is one row per electrode."""
    first = df.groupBy("idx").agg(*[F.min_by(c, "set_id").alias(c) for c in XYZ])
    now = np.array([[r[c] for c in XYZ] for r in first.orderBy("idx").collect()])
    for _ in range(repetitions):
        cols = df.select("set_id", "idx", *XYZ)
        mean = cols.groupBy("set_id").applyInPandas(_fitted_to(now), cols.schema).groupBy("idx").agg(*[F.avg(c).alias(c) for c in XYZ])
        now = np.array([[r[c] for c in XYZ] for r in mean.orderBy("idx").collect()])
    return df.sparkSession.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(now)], "idx int, x double, y double, z double")


def thin_out(df: DataFrame, count: int, by="set_id") -> DataFrame:
    """A set reduced to `count` points by farthest-point selection from its first, a set at a time."""
    cols = df.select(by, "idx", *XYZ)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        p = pdf[XYZ].to_numpy(float)
        keep, far = [0], np.linalg.norm(p - p[0], axis=1)
        while len(keep) < min(count, len(p)):
            keep.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(p - p[keep[-1]], axis=1))
        return pdf.iloc[sorted(keep)]

    return cols.groupBy(by).applyInPandas(run, cols.schema)


def from_landmarks(front, left, top, right, rear) -> list[list[float]]:
    """A transform that takes the centre of left and right to the origin, front to +x and left to +y, on the scale of the front-rear half distance."""
    front, left, top, right, rear = (np.asarray(p, float) for p in (front, left, top, right, rear))
    origin = (left + right) / 2
    x = front - rear
    half = np.linalg.norm(x) / 2
    x = x / np.linalg.norm(x)
    y = (left - right) - ((left - right) @ x) * x
    y /= np.linalg.norm(y)
    z = np.cross(x, y)
    z = z if (top - origin) @ z > 0 else -z
    r = np.stack([x, y, z]) / half
    return [[*r[k], -float(r[k] @ origin)] for k in range(3)] + [[0, 0, 0, 1]]


def spline_weights(known: np.ndarray, wanted: np.ndarray, degree: int = 4, terms: int = 50, ridge: float = 1e-5) -> np.ndarray:
    """Weights of spherical-spline interpolation (Perrin 1989) from known to wanted electrodes; solved once on the driver, a matrix of electrodes."""
    unit = lambda p: p / np.linalg.norm(p, axis=1, keepdims=True)

    def g(c):
        p0, p1, out = np.ones_like(c), c, np.zeros_like(c)
        for n in range(1, terms + 1):
            out += (2 * n + 1) / (n * (n + 1)) ** degree * p1
            p0, p1 = p1, ((2 * n + 1) * c * p1 - n * p0) / (n + 1)
        return out / (4 * np.pi)

    a, b, n = unit(known), unit(wanted), len(known)
    system = np.block([[g(np.clip(a @ a.T, -1, 1)) + ridge * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solve = np.linalg.inv(system)[:, :n]
    return np.hstack([g(np.clip(b @ a.T, -1, 1)), np.ones((len(b), 1))]) @ solve
