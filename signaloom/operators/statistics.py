"""Two-sample statistics per key, multiple-test corrections and p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    b = np.full_like(x, b) if np.ndim(b) == 0 else np.asarray(b, float)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = front * fraction(a, b, inside) / a
    high = 1 - front * fraction(b, a, 1 - inside) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(x < (a + 1) / (a + b + 2), low, high)))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, on Arrow batches."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        n, x = df.to_numpy(float), t.to_numpy(float)
        ok = np.isfinite(x) & (n > 0)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = incomplete_beta(n[ok] / 2, 0.5, n[ok] / (n[ok] + x[ok] ** 2))
        return pd.Series(out)

    return F.nanvl(p(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def t_unpaired(df: DataFrame, keys, group: str, first, second, value: str = "value") -> DataFrame:
    """keys, n1, n2, t, df with pooled variance: one aggregation over both groups."""
    a, b = (F.when(F.col(group) == g, F.col(value)) for g in (first, second))
    out = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("d"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    out = out.withColumn("df", F.col("n1") + F.col("n2") - 2)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif("df", F.lit(0))
    return out.withColumn("t", F.col("d") / F.nullif(F.sqrt(pooled * (1 / F.nullif("n1", F.lit(0)) + 1 / F.nullif("n2", F.lit(0)))), F.lit(0.0))).select(*keys, "n1", "n2", "t", "df")


def t_paired(pairs: DataFrame, keys, first: str, second: str) -> DataFrame:
    """keys, n, t, df of the differences first - second; a row per pair."""
    d = F.col(first) - F.col(second)
    out = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return out.select(*keys, "n", (F.col("m") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("t"), (F.col("n") - 1).alias("df"))


def randomised(pairs: DataFrame, keys, first: str, second: str, subject: str, times: int) -> DataFrame:
    """keys, m, p: paired randomization test; the sign of a subject's difference in a run is the parity of a hash of both, so reruns agree. `times` is bounded: runs are exploded per row, then aggregated at once."""
    d = pairs.select(*keys, F.col(subject).alias("_s"), (F.col(first) - F.col(second)).alias("d"))
    runs = d.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(times))))
    sign = F.when(F.col("run") == 0, 1).when(F.pmod(F.crc32(F.encode(F.concat_ws("/", F.col("_s").cast("string"), F.col("run").cast("string")), "UTF-8")), F.lit(2)) == 0, 1).otherwise(-1)
    means = runs.groupBy(*keys, "run").agg(F.avg(sign * F.col("d")).alias("m"))
    real = F.max(F.when(F.col("run") == 0, F.abs(F.round("m", 9)))).over(W.partitionBy(*keys)) if keys else F.max(F.when(F.col("run") == 0, F.abs(F.round("m", 9)))).over(W.partitionBy())
    means = means.withColumn("real", real)
    return means.groupBy(*keys).agg(F.max("real").alias("m"), F.avg(F.when(F.abs(F.round("m", 9)) >= F.col("real"), 1.0).otherwise(0.0)).alias("p"))


def randomised_unpaired(df: DataFrame, keys, group: str, value: str, subject: str, times: int) -> DataFrame:
    """keys, m, p: randomization test of two unpaired groups (a boolean column). In a run the subjects of a key are ordered by the MD5 of subject and run, and the first as many as the first group has are its members.
    A key's subjects of one run are the unit of work. m: absolute difference of the means; p: share of the runs, the real one included, that reach it. Keys where a group is empty have no row."""
    runs = df.select(*keys, F.col(subject).alias("_s"), F.col(group).alias("_g"), F.col(value).alias("_v")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(times))))
    own = W.partitionBy(*keys, "run")
    placed = runs.withColumn("_n", F.sum(F.col("_g").cast("int")).over(own))
    placed = placed.withColumn("_r", F.row_number().over(own.orderBy(F.md5(F.concat(F.col("_s").cast("string"), F.lit("/"), F.col("run").cast("string"))), "_s")))
    first = F.when(F.col("run") == 0, F.col("_g")).otherwise(F.col("_r") <= F.col("_n"))
    means = placed.groupBy(*keys, "run").agg(F.round(F.abs(F.avg(F.when(first, F.col("_v"))) - F.avg(F.when(~first, F.col("_v")))), 9).alias("m"))
    real = F.max(F.when(F.col("run") == 0, F.col("m"))).over(W.partitionBy(*keys))
    return means.withColumn("real", real).filter("real is not null").groupBy(*keys).agg(F.max("real").alias("m"), F.avg(F.when(F.col("m") >= F.col("real"), 1.0).otherwise(0.0)).alias("p"))


def topographic(maps: DataFrame, group: str, first, second, times: int, seed: int = 1) -> DataFrame:
    """dis, p: dissimilarity of two groups' mean maps (long: subject, group, e, x) against random exchange of subjects between groups, by a hash rank."""
    runs = maps.select("subject", group, "e", "x").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(times))))
    rank = F.percent_rank().over(W.partitionBy("run", "e").orderBy(F.xxhash64(F.lit(seed), "subject", "run"), "subject"))
    share = F.avg(F.when(F.col(group) == first, 1.0).otherwise(0.0)).over(W.partitionBy("run", "e"))
    side = F.when(F.col("run") == 0, F.col(group) == first).otherwise(rank < share)
    mean = runs.withColumn("side", side).groupBy("run", "e").agg(F.avg(F.when(F.col("side"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("side"), F.col("x"))).alias("b"))
    c = F.corr("a", "b")
    dis = mean.groupBy("run").agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * c)).alias("dis"))
    return dis.agg(F.max(F.when(F.col("run") == 0, F.col("dis"))).alias("dis"), F.count("*").alias("runs"), F.array_sort(F.collect_list("dis")).alias("_d")).select("dis", (F.size(F.filter("_d", lambda x: x >= F.col("dis"))) / F.col("runs")).alias("p"))


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    n = df.agg(F.count(p).alias("_n"))
    return df.crossJoin(n).withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")  # one row


def false_discovery(df: DataFrame, p: str = "p", by=()) -> DataFrame:
    """Benjamini-Hochberg q. Tests of one family are ranked together: a family is the unit of work."""
    w = W.partitionBy(*by)
    ranked = df.withColumn("_r", F.rank().over(w.orderBy(p))).withColumn("_n", F.count(p).over(w))
    ranked = ranked.withColumn("_r", F.max("_r").over(w.orderBy(p).rangeBetween(W.currentRow, W.currentRow)) + F.count("*").over(w.orderBy(p).rangeBetween(W.currentRow, W.currentRow)) - 1)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w.orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)))).drop("_r", "_n")


def shown(p: Column, how: str) -> Column:
    """p, 1 - p or -log10 p."""
    return {"p": p, "one_minus": 1 - p, "minus_log": -F.log10(p)}[how]
