"""Triggers and markers: naming, merging, scanning. Markers are rec, tf (or from_tf, to_tf) and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matching(df: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def rename(df: DataFrame, pattern: str, replacement: str, column: str = "name") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, pattern, replacement))


def split_bits(df: DataFrame, code: str, bits: int = 16) -> DataFrame:
    """A row for each bit that is set, numbered from 0."""
    return df.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.col(code).bitwiseAND(F.pow(F.lit(2.0), b).cast("long")) != 0)))


def runs(df: DataFrame, value: str, by=("rec",), order: str = "tf") -> DataFrame:
    """Gaps and islands: by, value, from_tf, to_tf, n of maximal runs of equal values over consecutive rows."""
    w = W.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(True)).over(w).isNotNull(), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order).alias("from_tf"), F.max(order).alias("to_tf"), F.count("*").alias("n"))


def merge_close(df: DataFrame, tolerance: int, by=("rec",)) -> DataFrame:
    """Markers whose frames are within tolerance of the one before become one: by, from_tf, to_tf, n."""
    w = W.partitionBy(*by).orderBy("tf")
    marked = df.withColumn("run", F.sum(F.when(F.col("tf") - F.lag("tf").over(w) <= tolerance, 0).otherwise(1)).over(w))
    return marked.groupBy(*by, "run").agg(F.min("tf").alias("from_tf"), F.max("tf").alias("to_tf"), F.count("*").alias("n")).drop("run")


def merge_overlapping(df: DataFrame) -> DataFrame:
    """Markers over exactly the same frames: their names joined by +."""
    return df.groupBy("rec", "from_tf", "to_tf").agg(F.array_join(F.array_sort(F.collect_set("name")), "+").alias("name"))


def delete_between(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(~F.col("tf").between(first, last))


def numbered(df: DataFrame, prefix: str) -> DataFrame:
    """name: prefix, old name and its number within the recording."""
    n = F.row_number().over(W.partitionBy("rec", "name").orderBy("tf"))
    return df.withColumn("name", F.concat_ws("_", F.lit(prefix), "name", n.cast("string")))


def neighbours(df: DataFrame, by=("rec",)) -> DataFrame:
    w = W.partitionBy(*by).orderBy("tf")
    return df.withColumns({"previous_tf": F.lag("tf").over(w), "next_tf": F.lead("tf").over(w)})


def extrema(df: DataFrame, by=("rec",), order="tf") -> DataFrame:
    """kind: max or min, of frames above (below) both neighbours."""
    w = W.partitionBy(*by).orderBy(order)
    before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    kind = F.when((v > before) & (v > after), "max").when((v < before) & (v < after), "min")
    return df.withColumn("kind", kind).filter("kind is not null")


def crossings(df: DataFrame, level: float, by=("rec",), order="tf") -> DataFrame:
    """First frames at or above the level after one below it, with the slope there."""
    w = W.partitionBy(*by).orderBy(order)
    before = F.lag("value").over(w)
    return df.withColumn("slope", F.col("value") - before).withColumn("hit", (F.col("value") >= level) & (before < level)).filter("hit").drop("hit")


def steepest(df: DataFrame, level: float, by=("rec",)) -> DataFrame:
    """The frame of the highest slope within each run at or above the level."""
    w = W.partitionBy(*by).orderBy("tf")
    marked = df.withColumn("up", F.col("value") >= level).withColumn("slope", F.abs(F.col("value") - F.lag("value").over(w)))
    marked = marked.withColumn("run", F.sum(F.when(F.col("up") & ~F.coalesce(F.lag("up").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("up")
    best = F.max(F.struct(F.coalesce("slope", F.lit(-1.0)).alias("slope"), (-F.col("tf")).alias("tf")))
    return marked.groupBy(*by, "run").agg(best.alias("b")).select(*by, "run", (-F.col("b.tf")).alias("tf"))


def lasting(df: DataFrame, condition: Column, least: int, most: int, gap: int = 0, by=("rec",)) -> DataFrame:
    """Runs where the condition holds for least to most frames, followed by at least gap frames where it does not (or the end)."""
    w = W.partitionBy(*by).orderBy("from_tf")
    held = runs(df.withColumn("on", condition), "on", by)
    held = held.withColumn("rest", F.lead("n").over(w))
    return held.filter(F.col("on") & F.col("n").between(least, most) & (F.col("rest").isNull() | (F.col("rest") >= gap))).select(*by, "from_tf", "to_tf", "n")
