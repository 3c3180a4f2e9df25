"""The driver's tables in the shape of recordings, maps and volumes; the same definitions as Spark frames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, sf_dir):
    """rec, tf, track, value, ts, event_id: one recording per user, time frames in the order of time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("tf"), F.col("event_type").alias("track"), "value", "ts", "event_id", "props")


def markers(spark, sf_dir):
    return samples(spark, sf_dir).filter(F.col("track").isin("signup", "error")).select("rec", "tf", F.col("track").alias("name"))


def maps(spark, sf_dir):
    """tf, label, v: one map per time frame."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tf"), "label", F.col("embedding").cast("array<double>").alias("v"))


def maps_long(spark, sf_dir):
    """tf, label, e, x: one row per electrode."""
    return maps(spark, sf_dir).select("tf", "label", F.posexplode("v").alias("e", "x"))


def templates(spark, sf_dir):
    """k, t: the mean of the average-referenced maps of each label."""
    long = maps(spark, sf_dir).select("label", F.posexplode(M.average_reference(F.col("v"))).alias("e", "x"))
    mean = long.groupBy("label", "e").agg(F.avg("x").alias("x"))
    return mean.groupBy(F.col("label").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda s: s["x"]).alias("t"))


def voxels(spark, sf_dir):
    """vol (a stack of 8 by 8 slices), x, y, z, v."""
    return maps_long(spark, sf_dir).select((F.col("e") % 8).alias("x"), F.floor(F.col("e") / 8).cast("int").alias("y"), F.col("tf").alias("z"), F.col("x").alias("v"))


SAMPLES = "samples as (select user_id rec, row_number() over (partition by user_id order by ts, event_id) - 1 tf, event_type track, value, ts, event_id, props from events)"
MARKERS = SAMPLES + ", markers as (select rec, tf, track as name from samples where track in ('signup', 'error'))"
LONG = "maps_long as (select vec_id tf, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 e from embeddings)"
REF = LONG + ", ref as (select tf, label, e, x - avg(x) over (partition by tf) x from maps_long)"
TEMPLATES = REF + ", tpl as (select label k, e, avg(x) x from ref group by 1, 2)"
FIT = (
    TEMPLATES
    + ", gfp as (select tf, stddev_pop(x) g from maps_long group by 1)"
    + ", cor as (select r.tf, t.k, sum(r.x * t.x) / sqrt(sum(r.x * r.x) * sum(t.x * t.x)) c from ref r join tpl t on r.e = t.e group by 1, 2)"
    + ", lab as (select tf, k seg, c corr, g from (select *, row_number() over (partition by tf order by round(abs(c), 9) desc, k) n from cor) join gfp using (tf) where n = 1)"
)
VOXELS = "vox as (select e % 8 x, e // 8 y, tf z, x v from (select vec_id tf, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 e from embeddings))"
