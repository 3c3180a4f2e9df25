"""Sampling frequencies and sessions of recordings: a small table rec, session, hz beside the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(samples: DataFrame, recordings: DataFrame, by=("rec",)) -> DataFrame:
    """The samples with session, hz and seconds since the start."""
    return samples.join(recordings, list(by)).withColumn("seconds", F.col("tf") / F.col("hz"))


def to_frequency(samples: DataFrame, recordings: DataFrame, hz: float, by=("rec",)) -> DataFrame:
    """Every recording down-sampled to about `hz`: of each run of round(own frequency / hz) frames the first stays, renumbered. Recordings that are slower already stay as they are."""
    ratio = F.greatest(F.lit(1), F.floor(F.col("hz") / hz + 0.5)).cast("long")
    kept = samples.join(recordings, list(by)).withColumn("_r", ratio).filter(F.col("tf") % F.col("_r") == 0)
    return kept.withColumn("tf", F.floor(F.col("tf") / F.col("_r")).cast("long")).withColumn("hz", F.col("hz") / F.col("_r")).drop("_r")


def for_highest(samples: DataFrame, recordings: DataFrame, highest: float, by=("rec",)) -> DataFrame:
    """Down-sampled as far as an analysis up to the frequency `highest` allows: frames stay at twice that frequency or more."""
    ratio = F.greatest(F.lit(1), F.floor(F.col("hz") / (2 * highest))).cast("long")
    kept = samples.join(recordings, list(by)).withColumn("_r", ratio).filter(F.col("tf") % F.col("_r") == 0)
    return kept.withColumn("tf", F.floor(F.col("tf") / F.col("_r")).cast("long")).withColumn("hz", F.col("hz") / F.col("_r")).drop("_r")


def per_session(samples: DataFrame, recordings: DataFrame, by=("rec",)) -> DataFrame:
    """session, track, n, mean: the recordings of a session as one group."""
    return timed(samples, recordings, by).groupBy("session", "track").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
