"""Selection, reference and rescaling of tracks. A recording is a long table rec, tf, track, value; every function takes and returns one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME, TRACK = ["rec", "tf"], ["rec", "track"]


def parse_list(text: str) -> list[int]:
    """`1, 2, 10-15` -> numbers."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    return out


def select_tracks(df: DataFrame, tracks) -> DataFrame:
    return df.filter(F.col("track").isin(list(tracks)))


def exclude_tracks(df: DataFrame, tracks) -> DataFrame:
    return df.filter(~F.col("track").isin(list(tracks)))


def with_role(df: DataFrame, roles: DataFrame, role: str, keep: bool = True) -> DataFrame:
    """Tracks of a role (regular, auxiliary, bad) kept or dropped; roles: track, role. A semi or anti join."""
    return df.join(roles.filter(F.col("role") == role).select("track"), "track", "left_semi" if keep else "left_anti")


def above_threshold(df: DataFrame, least: float) -> DataFrame:
    """Tracks of a recording whose largest absolute value reaches the threshold: an aggregation and a semi join, so the samples are not windowed."""
    return df.join(df.groupBy(*TRACK).agg(F.max(F.abs("value")).alias("m")).filter(F.col("m") >= least).select(*TRACK), TRACK, "left_semi")


def interval(df: DataFrame, first: int, last: int | None = None) -> DataFrame:
    return df.filter(F.col("tf") >= first) if last is None else df.filter(F.col("tf").between(first, last))


def around(df: DataFrame, marks: DataFrame, before: int, after: int, keep: bool = True) -> DataFrame:
    """Samples in (or outside) the intervals around markers rec, tf. Intervals are dealt into blocks of their length, so the range join is an equi-join."""
    block = before + after + 1
    near = marks.select("rec", (F.col("tf") - before).alias("from"), (F.col("tf") + after).alias("to"))
    near = near.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor(F.col("to") / block)))).alias("m")
    s = df.withColumn("block", F.floor(F.col("tf") / block)).alias("s")
    on = (F.col("s.rec") == F.col("m.rec")) & (F.col("s.block") == F.col("m.block")) & F.col("s.tf").between(F.col("m.from"), F.col("m.to"))
    return s.join(near, on, "left_semi" if keep else "left_anti").drop("block")


def downsample(df: DataFrame, ratio: int) -> DataFrame:
    return df.filter(F.col("tf") % ratio == 0).withColumn("tf", (F.col("tf") / ratio).cast("long"))


def time_average(df: DataFrame) -> DataFrame:
    return df.groupBy(*TRACK).agg(F.avg("value").alias("value"))


def null_track(df: DataFrame, name: str) -> DataFrame:
    return df.unionByName(df.select(*FRAME).distinct().withColumns({"track": F.lit(name), "value": F.lit(0.0)}), allowMissingColumns=True)


def baseline(df: DataFrame, first: int, last: int) -> DataFrame:
    """Less the track's mean over an interval; without samples there, unchanged."""
    base = df.filter(F.col("tf").between(first, last)).groupBy(*TRACK).agg(F.avg("value").alias("base"))
    return df.join(base, TRACK, "left").withColumn("value", F.col("value") - F.coalesce("base", F.lit(0.0))).drop("base")


def remove_dc(df: DataFrame) -> DataFrame:
    mean = df.groupBy(*TRACK).agg(F.avg("value").alias("mean"))
    return df.join(mean, TRACK).withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def rescale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("value", F.col("value") * factor)


def standardise(df: DataFrame) -> DataFrame:
    """z-scores in time, with n - 1; null where a track is constant."""
    stats = df.groupBy(*TRACK).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return df.join(stats, TRACK).withColumn("value", (F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))).drop("m", "s")


def rank_filter(df: DataFrame, keys=("rec", "tf")) -> DataFrame:
    return df.withColumn("value", F.percent_rank().over(W.partitionBy(*keys).orderBy("value")))


def rectify(df: DataFrame, power: bool = False) -> DataFrame:
    return df.withColumn("value", F.col("value") * F.col("value") if power else F.abs("value"))


def envelope(df: DataFrame, half: int, by=("rec", "track")) -> DataFrame:
    """Largest absolute value within half frames on either side."""
    return df.withColumn("value", F.max(F.abs("value")).over(W.partitionBy(*by).orderBy("tf").rowsBetween(-half, half)))


def threshold(value, first: float, second: float) -> Column:
    """Keeps what lies between first and second; given in falling order, what lies outside. The rest is 0."""
    inside = F.col(value).between(min(first, second), max(first, second))
    return F.when(inside if first <= second else ~inside, F.col(value)).otherwise(F.lit(0.0))


def montage(df: DataFrame, plus, minus, keys=("rec", "tf")) -> DataFrame:
    """The difference of two tracks, frame by frame, by one aggregation instead of a self-join."""
    pick = lambda t: F.max(F.when(F.col("track") == t, F.col("value")))
    return df.filter(F.col("track").isin(plus, minus)).groupBy(*keys).agg((pick(plus) - pick(minus)).alias("value")).filter("value is not null")


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Recordings one after the other: each part's frames follow the last frame of the parts before."""
    lengths = None
    for n, p in enumerate(parts):
        one = p.groupBy("rec").agg((F.max("tf") + 1).alias("n")).withColumn("part", F.lit(n))
        lengths = one if lengths is None else lengths.unionByName(one)
    offset = lengths.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("rec").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    whole = parts[0].withColumn("part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        whole = whole.unionByName(p.withColumn("part", F.lit(n)))
    return whole.join(offset, ["rec", "part"]).withColumn("tf", F.col("tf") + F.col("offset")).drop("offset", "part")


def robust_outliers(df: DataFrame, statistic: Column, limit: float = 3.0) -> DataFrame:
    """rec, track, s, z: a statistic of each track and its robust z (median, MAD) among the recordings' same track."""
    per = df.groupBy(*TRACK).agg(statistic.alias("s"))
    centre = per.groupBy("track").agg(F.percentile("s", F.lit(0.5)).alias("med"))
    per = per.join(centre, "track")
    spread = per.groupBy("track").agg(F.percentile(F.abs(F.col("s") - F.col("med")), F.lit(0.5)).alias("mad"))
    per = per.join(spread, "track").withColumn("z", (F.col("s") - F.col("med")) / F.nullif(1.4826 * F.col("mad"), F.lit(0.0)))
    return per.select("rec", "track", "s", "z", (F.abs("z") > limit).alias("bad"))


def histogram(df: DataFrame, low: float, high: float, bins: int, by=()) -> DataFrame:
    """bin, n, log_n, smooth (mean of 3 bins), cdf per group."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) / (high - low) * bins))).cast("int")
    counts = df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    run = W.partitionBy(*by).orderBy("bin")
    return counts.select(
        *by, "bin", "n", F.log1p(F.col("n").cast("double")).alias("log_n"), F.avg("n").over(run.rowsBetween(-1, 1)).alias("smooth"),
        (F.sum("n").over(run) / F.sum("n").over(W.partitionBy(*by))).alias("cdf"),
    )


def calculate(frames: dict[str, DataFrame], expression: str, keys=("rec", "tf")) -> DataFrame:
    """File calculator: frames aligned on their keys, each with a column of its group's name; the expression is Spark SQL over those names."""
    out = None
    for name, df in frames.items():
        one = df.select(*keys, F.col("value").alias(name))
        out = one if out is None else out.join(one, list(keys))
    return out.select(*keys, F.expr(expression).alias("value"))
