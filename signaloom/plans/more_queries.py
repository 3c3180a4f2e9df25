"""Centroids, set operations on markers, names, and composites over volumes and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps as M
from ..operators import geometry as G
from ..operators import microstates as MS
from ..operators import volumes as VO
from . import commands as C
from . import views as V
from .catalog import register
from .signal_queries import r6

K = V.markers
_MK = f"with {V.MARKERS} "
register("centroid_average", lambda s, d: V.maps_long(s, d).groupBy("label", "e").agg(r6(F.avg("x")).alias("x")), f"with {V.LONG} select label, e, round(avg(x), 6) x from maps_long group by 1, 2")
register("centroid_median", lambda s, d: V.maps_long(s, d).groupBy("label", "e").agg(r6(F.percentile("x", F.lit(0.5))).alias("x")), f"with {V.LONG} select label, e, round(median(x), 6) x from maps_long group by 1, 2")
register(
    "centroid_weighted",
    lambda s, d: V.maps(s, d).select("label", M.gfp(F.col("v")).alias("g"), F.posexplode("v").alias("e", "x")).groupBy("label", "e").agg(r6(F.sum(F.col("g") * F.col("x")) / F.sum("g")).alias("x")),
    f"with {V.LONG}, g as (select tf, stddev_pop(x) g from maps_long group by 1) select label, e, round(sum(g * x) / sum(g), 6) x from maps_long join g using (tf) group by 1, 2",
)
register("centroid_medoid", lambda s, d: MS.medoid(V.maps(s, d)))
register("centroid_eigenvector", lambda s, d: MS.eigenvector(V.maps(s, d)).select("label", F.posexplode("v").alias("e", "x")).select("label", "e", r6("x").alias("x")))
register("marker_intersect", lambda s, d: K(s, d).filter("name = 'error'").select("rec", "tf").intersect(V.samples(s, d).filter("value > 100").select("rec", "tf")), _MK + "select rec, tf from markers where name = 'error' intersect select rec, tf from samples where value > 100")
register("marker_except", lambda s, d: K(s, d).select("rec", "tf").exceptAll(V.samples(s, d).filter("value > 100").select("rec", "tf")), _MK + "select rec, tf from markers except all select rec, tf from samples where value > 100")
register("marker_replace", lambda s, d: K(s, d).withColumn("name", F.replace("name", F.lit("sign"), F.lit("log"))), _MK + "select rec, tf, replace(name, 'sign', 'log') as name from markers")
register("names_composed", lambda s, d: V.samples(s, d).select("rec", "track").distinct().select(F.concat(F.lit("rec"), F.col("rec").cast("string"), F.lit("."), "track", F.lit(".ep")).alias("file")), f"with {V.SAMPLES} select distinct 'rec' || rec || '.' || track || '.ep' file from samples")
register("names_distinct", lambda s, d: V.samples(s, d).groupBy("track").agg(F.count_distinct("value").alias("n")), f"with {V.SAMPLES} select track, count(distinct value) n from samples group by 1")
register("vol_skull_strip", lambda s, d: VO.strip(V.voxels(s, d), 0.0).select("x", "y", "z", r6("v").alias("v")))
def _ported(s, d):
    """The mean points moved into the space of the first map's points."""
    from .space_queries import _points

    mean = _points(s, d).groupBy("idx").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return G.transform(mean, [[1, 0, 0, 0.02], [0, 1, 0, -0.02], [0, 0, 1, 0], [0, 0, 0, 1]]), _points(s, d).groupBy("idx").agg(*[F.min_by(c, "set_id").alias(c) for c in "xyz"])


def _tracks(s, d):
    return V.maps_long(s, d).select(F.col("label").alias("rec"), "tf", F.col("e").alias("track"), F.col("x").alias("value"))


register(
    "command_reprocess_tracks",
    lambda s, d: C.reprocess_tracks(_tracks(s, d), "0-7, 12", reference="average", rectify=True, factor=2.0).select("rec", "tf", "track", r6("value").alias("value")),
    f"with {V.LONG}, k as (select label rec, tf, e track, x from maps_long where e <= 7 or e = 12) select rec, tf, track, round(2 * abs(x - avg(x) over (partition by rec, tf)), 6) as value from k",
)
register(
    "command_computing_ris",
    lambda s, d: C.computing_ris(_tracks(s, d), _inverse(s)).select("rec", "tf", "sp", r6("v").alias("v")),
    f"with {V.LONG}, r as (select label rec, tf, sp, axis, sum(x * sin((3 * sp + axis + 1) * (e + 1)) / 8) v from maps_long, (select unnest(range(12)) sp), (select unnest(range(3)) axis) group by 1, 2, 3, 4) select rec, tf, sp::int sp, round(sqrt(sum(v * v)), 6) v from r group by 1, 2, 3",
)


def _inverse(s):
    from .space_queries import _inverse

    return _inverse(s)
