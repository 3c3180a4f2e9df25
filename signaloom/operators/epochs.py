"""Epochs around triggers: range joins, rejection, averages. Samples rec, tf, track, value; origins rec, tf, name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(samples: DataFrame, origins: DataFrame, before: int, after: int) -> DataFrame:
    """rec, origin, name, rel, track, value: samples from before to after frames around each origin.

    The range join is an equi-join: frames are dealt into blocks as long as an epoch, and an epoch meets the two or so blocks that it covers.
    """
    block = before + after + 1
    o = origins.select("rec", F.col("tf").alias("origin"), "name")
    o = o.withColumn("block", F.explode(F.sequence(F.floor((F.col("origin") - before) / block), F.floor((F.col("origin") + after) / block))))
    s = samples.select("rec", "tf", "track", "value", F.floor(F.col("tf") / block).alias("block"))
    rel = F.col("tf") - F.col("origin")
    return s.join(o, ["rec", "block"]).filter(rel.between(-before, after)).select("rec", "origin", "name", rel.alias("rel"), "track", "value")


def accepted(epochs: DataFrame, limit: float, excluded=()) -> DataFrame:
    """Epochs whose samples all stay within +-limit, tracks in `excluded` aside; an aggregation and a semi join."""
    fine = epochs.filter(~F.col("track").isin(list(excluded))) if excluded else epochs
    fine = fine.groupBy("rec", "origin", "name").agg(F.max(F.abs("value")).alias("m")).filter(F.col("m") <= limit).select("rec", "origin", "name")
    return epochs.join(fine, ["rec", "origin", "name"], "left_semi")


def statistics() -> list[Column]:
    return [F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se")]


def average(epochs: DataFrame, keys=("rel",)) -> DataFrame:
    return epochs.groupBy(*keys).agg(*statistics())


def average_split_and_merged(epochs: DataFrame) -> DataFrame:
    """A result per trigger name and one over all (name null), in one pass by grouping sets."""
    return epochs.groupingSets([["name", "rel"], ["rel"]], "name", "rel").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def validated(origins: DataFrame, accept: DataFrame) -> DataFrame:
    """Origins on the accept list (rec, tf)."""
    return origins.join(accept, ["rec", "tf"], "left_semi")


def reaction(origins: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """Each origin with the first event at or after it within `most` frames: an as-of join as a union and one window, no inequality join."""
    both = origins.select("rec", "tf", F.lit(1).alias("kind"), "name").unionByName(events.select("rec", "tf", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("name")))
    ahead = W.partitionBy("rec").orderBy(F.col("tf").desc(), F.col("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("event_tf", F.last(F.when(F.col("kind") == 0, F.col("tf")), ignorenulls=True).over(ahead)).filter("kind = 1")
    return found.filter(F.col("event_tf") - F.col("tf") <= most).select("rec", "tf", "name", "event_tf", (F.col("event_tf") - F.col("tf")).alias("latency"))


def resampled(frames: DataFrame, by: str, size: int, coverage: float, least: int = 1) -> DataFrame:
    """by, n, tf: epochs of `size` frames at starts drawn by a hash over all frames of each `by`.

    A frame lies in one of n epochs with a chance of about 1 - (1 - size / frames)^n; n is the least number that brings it to `coverage` (below 1), and `least` at least. Of fewer than `size` frames all are taken.
    """
    place = frames.select(by, "tf", (F.row_number().over(W.partitionBy(by).orderBy("tf")) - 1).cast("long").alias("at"))
    missed = 1 - F.lit(float(size)) / F.col("frames")
    epochs = F.greatest(F.lit(least), F.when(missed > 0, F.ceil(F.log(F.lit(1 - coverage)) / F.log(missed))).otherwise(1))
    lots = frames.groupBy(by).agg(F.count("*").alias("frames")).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), (epochs - 1).cast("long"))))
    drawn = F.crc32(F.encode(F.concat_ws("/", F.col(by).cast("string"), F.col("n").cast("string")), "UTF-8"))
    start = F.pmod(drawn, F.greatest(F.col("frames") - size + 1, F.lit(1)))
    return lots.withColumn("at", F.explode(F.sequence(start, start + size - 1))).join(place, [by, "at"]).select(by, F.col("n").cast("int").alias("n"), "tf")


def grand_average(df: DataFrame, group: str, subject: str, value: str = "value") -> DataFrame:
    """Means per subject, of the subjects' means per group, and overall: two aggregations, the second a rollup."""
    per = df.groupBy(group, subject).agg(F.avg(value).alias("m"))
    return per.rollup(group, subject).agg(F.avg("m").alias("mean"), F.count("*").alias("n"))
