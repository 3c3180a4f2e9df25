"""Inverse solutions: lead field, inverse matrices, the product with maps and what follows it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 13


def product(maps: DataFrame, inverse: DataFrame, keys=("tf",)) -> DataFrame:
    """keys, sp, axis, v: maps (long: e, x) times an inverse matrix (sp, axis, e, w), as a join on electrodes and a sum."""
    return maps.join(inverse, "e").groupBy(*keys, "sp", "axis").agg(F.sum(F.col("x") * F.col("w")).alias("v"))


def product_batched(maps: DataFrame, matrix: np.ndarray, keys=("tf",)) -> DataFrame:
    """The same for maps as arrays `v` and one matrix that fits a task: a dense product on Arrow batches; keys, r (array of rows of the matrix)."""
    kinds = dict(maps.dtypes)

    def run(batches):
        for b in batches:
            if len(b):
                yield b[list(keys)].assign(r=list(np.stack(b.v.to_numpy()) @ matrix.T))

    return maps.select(*keys, "v").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", r array<double>")


def norm(ris: DataFrame, keys=("tf",)) -> DataFrame:
    return ris.groupBy(*keys, "sp").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def lead_field(electrodes: np.ndarray, points: np.ndarray, conductivity: float = 0.33) -> np.ndarray:
    """Electrodes by 3 * points: potential of unit dipoles in a homogeneous conductor, average-referenced over electrodes."""
    d = electrodes[:, None, :] - points[None, :, :]
    field = d / (4 * np.pi * conductivity * np.maximum(np.linalg.norm(d, axis=2, keepdims=True), 1e-9) ** 3)
    field = field.reshape(len(electrodes), -1)
    return field - field.mean(0)


def inverse_matrices(lead: np.ndarray, model: str = "mn", levels: int = LEVELS, points: np.ndarray | None = None) -> list[np.ndarray]:
    """3 * points by electrodes for each regularization level; level 0 has none, the rest follow a geometric ladder.

    mn: minimum norm; wmn: lead-field weighted; sdale and sloreta: standardised by noise or source variance; eloreta: weights iterated; loreta: Laplacian-weighted; laura: distance-weighted.
    """
    n, m = lead.shape
    sp = m // 3
    gain = np.sqrt((lead.reshape(n, sp, 3) ** 2).sum((0, 2)))
    weight = np.ones(sp)
    prior = None
    if model in ("wmn", "loreta", "laura"):
        weight = 1 / np.maximum(gain, 1e-12) ** 2
    if model in ("loreta", "laura"):
        gap = np.linalg.norm(points[:, None] - points[None, :], axis=2)
        close = np.where(np.eye(sp, dtype=bool), 0, 1 / np.maximum(gap, 1e-6) ** (3 if model == "laura" else 2))
        close /= close.sum(1, keepdims=True)
        lap = np.eye(sp) - 0.99 * close
        prior = np.linalg.inv(lap.T @ np.diag(1 / weight) @ lap)
    out = []
    for k in range(levels):
        w = weight.copy()
        for _ in range(20 if model == "eloreta" else 1):
            if prior is not None:
                source = np.kron(prior, np.eye(3))
                kernel = lead @ source @ lead.T
            else:
                source = np.repeat(w, 3)
                kernel = (lead * source) @ lead.T
            alpha = 0 if k == 0 else np.trace(kernel) / n * 10 ** (-4 + 4 * (k - 1) / max(1, levels - 2))
            core = np.linalg.pinv(kernel + alpha * np.eye(n), hermitian=True)
            if model == "eloreta":
                w = 1 / np.maximum(np.sqrt(np.einsum("ea,ef,fa->a", lead, core, lead).reshape(sp, 3).mean(1)), 1e-12)
        t = source @ lead.T @ core if prior is not None else (lead * source).T @ core
        if model == "sdale":
            t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        if model == "sloreta":
            t = t / np.sqrt(np.maximum(np.einsum("ae,ea->a", t, lead), 1e-12))[:, None]
        out.append(t)
    return out


def as_table(spark, matrices: list[np.ndarray]) -> DataFrame:
    """reg, sp, axis, e, w of a list of matrices."""
    rows = [(r, a // 3, a % 3, e, float(m[a, e])) for r, m in enumerate(matrices) for a in range(m.shape[0]) for e in range(m.shape[1])]
    return spark.createDataFrame(rows, "reg int, sp int, axis int, e int, w double")


def best_level(maps: DataFrame, inverse: DataFrame, lead: DataFrame, keys=("tf",)) -> DataFrame:
    """keys, reg: the level of least generalised cross-validation-like residual (residual power over squared rest of freedom, here residual plus solution norm). Maps as arrays `v`; the smaller level on a tie.

    A level's inverse W and the lead field L enter by the matrices L W and W' W alone, of electrodes squared, whatever the number of solution points: Spark sums them, and every map is finished in its own row,
    without a shuffle. Missing values and electrodes without weights add nothing; a map with no electrode of the lead field has no level.
    """
    other = inverse.select("reg", "sp", "axis", F.col("e").alias("f"), F.col("w").alias("u"))
    gram = inverse.join(other, ["reg", "sp", "axis"]).groupBy("reg", "e", "f").agg(F.sum(F.col("w") * F.col("u")).alias("c")).collect()  # levels times electrodes squared
    back = inverse.join(lead.withColumnRenamed("e", "f"), ["sp", "axis"]).groupBy("reg", "e", "f").agg(F.sum(F.col("w") * F.col("l")).alias("c")).collect()
    regs, n = sorted({r["reg"] for r in gram}), 1 + max((max(r["e"], r["f"]) for r in gram + back), default=-1)
    power, field = np.zeros((len(regs), n, n)), np.zeros((len(regs), n, n))
    for r in gram:
        power[regs.index(r["reg"]), r["e"], r["f"]] = r["c"]
    for r in back:
        field[regs.index(r["reg"]), r["e"], r["f"]] = r["c"]
    known, seen = np.zeros(n, bool), np.zeros(n, bool)
    known[[r["e"] for r in gram]], seen[[r["f"] for r in back]] = True, True
    kinds = dict(maps.dtypes)

    def run(batches):
        for b in batches:
            b = b[[v is not None and known[: len(v)].any() and seen[: len(v)].any() for v in b.v]]
            if not len(b):
                continue
            x = np.full((len(b), n), np.nan)
            for row, v in zip(x, b.v):
                row[: len(v)] = np.asarray(v, float)[:n]
            x[:, ~known & ~seen] = np.nan
            cost, held = [], np.nan_to_num(x)
            for g, f in zip(power, field):
                rest = np.where(np.isnan(x) | ~seen, 0, x - held @ f)
                cost.append(np.round(np.log((rest**2).sum(1) + 1e-12) + np.log(np.maximum(((held @ g) * held).sum(1), 0) + 1e-12), 9))
            yield b[list(keys)].assign(reg=np.array(regs)[np.argmin(cost, axis=0)])

    return maps.select(*keys, "v").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", reg {dict(inverse.dtypes)['reg']}")


def to_volume(ris: DataFrame, places: DataFrame, power: float = 2.0) -> DataFrame:
    """keys, x, y, z, v: each voxel the inverse-distance mean of its solution points; places: x, y, z, sp, d (from geometry.nearest)."""
    weight = 1 / F.pow(F.col("d") + 1e-6, power)
    return ris.join(places, "sp").groupBy("tf", "x", "y", "z").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("v"))


def principal(maps: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and components (rows, largest entry positive) of the electrodes' covariance, which Spark sums as a matrix of electrodes."""
    other = maps.select("tf", F.col("e").alias("f"), F.col("x").alias("y"))
    cov = maps.join(other, "tf").groupBy("e", "f").agg(F.covar_samp("x", "y").alias("c")).collect()  # electrodes squared
    n = max(r["e"] for r in cov) + 1
    m = np.zeros((n, n))
    for r in cov:
        m[r["e"], r["f"]] = r["c"]
    values, vectors = np.linalg.eigh(m)
    top = vectors[:, ::-1][:, :count].T
    return values[::-1][:count], top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def independent(x: np.ndarray, count: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """FastICA unmixing of samples as rows, after whitening; symmetric decorrelation, tanh."""
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    white = vectors[:, ::-1][:, :count] / np.sqrt(np.maximum(values[::-1][:count], 1e-12))
    z, w = x @ white, np.random.default_rng(seed).normal(size=(count, count))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(w)
        w = u @ vt
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(0)) @ w
        u, _, vt = np.linalg.svd(new)
        if np.abs(np.abs(np.diag(u @ vt @ w.T)) - 1).max() < 1e-8:
            break
        w = u @ vt
    return w @ white.T
