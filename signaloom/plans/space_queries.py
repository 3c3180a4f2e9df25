"""Queries over source space, volumes, points, synthetic data and streams, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M
from ..operators import geometry as G
from ..operators import source_space as SS
from ..operators import volumes as VO
from ..streaming import windows as ST
from . import views as V
from .catalog import register
from .signal_queries import r6

# --- source space: inverse matrix of 12 points, 3 axes, 64 electrodes, w = sin((3 sp + axis + 1)(e + 1)) / 8 ----------------------------------------------------------------------
SP = 12
_MATRIX = np.array([[math.sin((r + 1) * (e + 1)) / 8 for e in range(64)] for r in range(3 * SP)])


def _inverse(s):
    rows = s.range(SP).select(F.col("id").cast("int").alias("sp"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("axis")).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("w", F.sin(((3 * F.col("sp") + F.col("axis") + 1) * (F.col("e") + 1)).cast("double")) / 8)


def _ris(s, d):
    return SS.product(V.maps_long(s, d).select("tf", "e", "x"), _inverse(s))


_INV = f"inv as (select sp, axis, e, sin((3 * sp + axis + 1) * (e + 1)) / 8 w from (select unnest(range({SP})) sp), (select unnest(range(3)) axis), (select unnest(range(64)) e))"
_RIS = f"{V.LONG}, {_INV}, ris as (select tf, sp::int sp, axis::int axis, sum(x * w) v from maps_long join inv using (e) group by 1, 2, 3), nrm as (select tf, sp, sqrt(sum(v * v)) v from ris group by 1, 2)"
register("ris_matmul", lambda s, d: _ris(s, d).select("tf", "sp", "axis", r6("v").alias("v")), f"with {_RIS} select tf, sp, axis, round(v, 6) v from ris")
register(
    "ris_matmul_batched",
    lambda s, d: SS.product_batched(V.maps(s, d), _MATRIX).select("tf", F.posexplode("r").alias("i", "v")).select("tf", F.floor(F.col("i") / 3).cast("int").alias("sp"), (F.col("i") % 3).alias("axis"), r6("v").alias("v")),
    f"with {_RIS} select tf, sp, axis, round(v, 6) v from ris",
)
register("ris_norm", lambda s, d: SS.norm(_ris(s, d)).select("tf", "sp", r6("v").alias("v")), f"with {_RIS} select tf, sp, round(v, 6) v from nrm")


def _z(s, d):
    n = SS.norm(_ris(s, d))
    f = n.groupBy("sp").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return n.join(f, "sp").select("tf", "sp", ((F.col("v") - F.col("m")) / F.col("sd")).alias("v"))


register("ris_zscore", lambda s, d: _z(s, d).select("tf", "sp", r6("v").alias("v")), f"with {_RIS} select tf, sp, round((v - avg(v) over (partition by sp)) / stddev_samp(v) over (partition by sp), 6) v from nrm")
register("ris_ranking", lambda s, d: SS.norm(_ris(s, d)).select("tf", "sp", r6(F.percent_rank().over(W.partitionBy("tf").orderBy("v"))).alias("v")), f"with {_RIS} select tf, sp, round(percent_rank() over (partition by tf order by v), 6) v from nrm")
register("ris_rois", lambda s, d: SS.norm(_ris(s, d)).groupBy("tf", (F.col("sp") % 3).alias("roi")).agg(r6(F.avg("v")).alias("v")), f"with {_RIS} select tf, sp % 3 roi, round(avg(v), 6) v from nrm group by 1, 2")
register(
    "ris_average_before",
    lambda s, d: SS.norm(SS.product(V.maps_long(s, d).groupBy("label", "e").agg(F.avg("x").alias("x")), _inverse(s), ("label",)), ("label",)).select("label", "sp", r6("v").alias("v")),
    f"with {V.LONG}, {_INV}, m as (select label, e, avg(x) x from maps_long group by 1, 2), p as (select label, sp, axis, sum(x * w) v from m join inv using (e) group by 1, 2, 3) select label, sp::int sp, round(sqrt(sum(v * v)), 6) v from p group by 1, 2",
)
register(
    "ris_average_after",
    lambda s, d: SS.norm(_ris(s, d)).join(V.maps(s, d).select("tf", "label"), "tf").groupBy("label", "sp").agg(r6(F.avg("v")).alias("v")),
    f"with {_RIS} select label, sp, round(avg(nrm.v), 6) v from nrm join embeddings e on e.vec_id = nrm.tf group by 1, 2",
)
register("ris_find_max", lambda s, d: SS.norm(_ris(s, d)).groupBy("sp").agg(F.max(F.struct(F.round("v", 9).alias("v"), (-F.col("tf")).alias("t"))).alias("b")).select("sp", (-F.col("b.t")).alias("tf")), f"with {_RIS} select sp, tf from (select *, row_number() over (partition by sp order by round(v, 9) desc, tf) n from nrm) where n = 1")
register("ris_cloud", lambda s, d: _ris(s, d).groupBy("tf", "sp").agg(*[r6(F.sum(F.when(F.col("axis") == a, F.col("v")))).alias(n) for a, n in enumerate(("vx", "vy", "vz"))]), f"with {_RIS} select tf, sp, " + ", ".join(f"round(sum(v) filter (where axis = {a}), 6) {n}" for a, n in enumerate(("vx", "vy", "vz"))) + " from ris group by 1, 2")


def _grid(s, n=4):
    side = F.sequence(F.lit(0), F.lit(n - 1))
    return s.range(1).select(F.explode(side).alias("x"), F.lit(1).alias("o")).withColumn("y", F.explode(side)).withColumn("z", F.explode(side)).drop("o")


def _sources(s):
    return s.range(SP).select(F.col("id").cast("int").alias("idx"), (F.col("id") % 3).cast("double").alias("x"), (F.floor(F.col("id") / 3) % 2).cast("double").alias("y"), F.floor(F.col("id") / 6).cast("double").alias("z"))


def _places(s):
    voxels = _grid(s).withColumn("idx", F.col("x") + 4 * F.col("y") + 16 * F.col("z"))
    near = G.nearest(voxels, _sources(s), 3, 10.0)
    return near.join(voxels, "idx").select("x", "y", "z", F.col("near").alias("sp"), "d")


register(
    "ris_to_volume",
    lambda s, d: SS.to_volume(SS.norm(_ris(s, d)), _places(s)).select("tf", "x", "y", "z", r6("v").alias("v")),
    f"with {_RIS}, sp as (select i::int sp, (i % 3)::double x, (i // 3 % 2)::double y, (i // 6)::double z from (select unnest(range({SP})) i)), vx as (select x::int x, y::int y, z::int z from (select unnest(range(4)) x), (select unnest(range(4)) y), (select unnest(range(4)) z)), pl as (select * from (select vx.*, sp.sp, sqrt((vx.x - sp.x) ** 2 + (vx.y - sp.y) ** 2 + (vx.z - sp.z) ** 2) d, row_number() over (partition by vx.x, vx.y, vx.z order by round(sqrt((vx.x - sp.x) ** 2 + (vx.y - sp.y) ** 2 + (vx.z - sp.z) ** 2), 9), sp.sp) n from vx, sp) where n <= 3) select tf, x, y, z, round(sum(v / power(d + 1e-6, 2)) / sum(1 / power(d + 1e-6, 2)), 6) v from nrm join pl using (sp) group by 1, 2, 3, 4",
)


def _head():
    """Electrodes on a sphere by the golden angle, and source points inside it."""
    i = np.arange(64)
    z, a = 1 - (i + 0.5) / 64, i * math.pi * (3 - math.sqrt(5))
    e = np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], 1)
    return e, e[::6] * 0.6


def _models(s, d):
    e, p = _head()
    lead, out = SS.lead_field(e, p), []
    for model in ("mn", "wmn", "sdale", "sloreta", "loreta", "laura", "eloreta"):
        for reg, m in enumerate(SS.inverse_matrices(lead, model, points=p)):
            out.append((model, reg, float(np.linalg.norm(m)), float(np.trace(m @ lead) / lead.shape[1])))
    return s.createDataFrame(out, "model string, reg int, size double, gain double")


register("inverse_models", lambda s, d: _models(s, d).select("model", "reg", r6("size").alias("size"), r6("gain").alias("gain")))


def _regularised(s, d):
    e, p = _head()
    lead = SS.lead_field(e, p[:4])
    field = s.createDataFrame([(a // 3, a % 3, k, float(lead[k, a])) for k in range(64) for a in range(12)], "sp int, axis int, e int, l double")
    return SS.best_level(V.maps(s, d), SS.as_table(s, SS.inverse_matrices(lead, "mn")), field)


register("ris_best_regularization", _regularised)
register("pca_covariance", lambda s, d: V.maps_long(s, d).select("tf", "e", "x").join(V.maps_long(s, d).select("tf", F.col("e").alias("f"), F.col("x").alias("y")), "tf").groupBy("e", "f").agg((r6(F.covar_samp("x", "y")) + 0.0).alias("c")), f"with {V.LONG} select a.e, b.e f, round(covar_samp(a.x, b.x), 6) + 0.0::double c from maps_long a join maps_long b using (tf) group by 1, 2")


def _pca(s, d):
    values, parts = SS.principal(V.maps_long(s, d).select("tf", "e", "x"), 3)
    return SS.product_batched(V.maps(s, d), parts).select("tf", F.posexplode("r").alias("component", "v")).select("tf", "component", r6("v").alias("v"))


register("pca_projection", _pca)


def _ica(s, d):
    def run(pdf):
        x = np.stack(pdf.sort_values("tf").v.to_numpy())
        w = SS.independent(x, 3)
        return pdf[["label"]].assign(tf=np.sort(pdf.tf.to_numpy()), c=list((x - x.mean(0)) @ w.T))

    return V.maps(s, d).select("label", "tf", "v").groupBy("label").applyInPandas(run, "label int, tf long, c array<double>").select("label", "tf", F.size("c").alias("n"))


register("ica_components", _ica)


def _interpolated(s, d):
    e, _ = _head()
    bad = [5, 20]
    good = [k for k in range(64) if k not in bad]
    w = G.spline_weights(e[good], e[bad])
    weights = s.createDataFrame([(bad[b], good[g], float(w[b, g])) for b in range(len(bad)) for g in range(len(good))], "to int, e int, w double")
    return V.maps_long(s, d).join(weights, "e").groupBy("tf", F.col("to").alias("e")).agg(r6(F.sum(F.col("x") * F.col("w"))).alias("x"))


register("interpolate_bad_electrodes", _interpolated)

# --- volumes ------------------------------------------------------------------------------------------------------------------------------------------------------------------
X = V.voxels
VQ = f"with {V.VOXELS} "
_NB = "(select a.x, a.y, a.z, a.v own, b.v from vox a join vox b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) <= 1)"


def _vox(df, *cols):
    return df.select("x", "y", "z", *[r6(c).alias(c) for c in cols or ("v",)])


def _local(expr):
    return VQ + f"select x::int x, y::int y, z, {expr} from {_NB} group by x, y, z"


register("vol_threshold", lambda s, d: _vox(X(s, d).withColumn("v", F.when(F.col("v").between(-0.1, 0.1), F.col("v")).otherwise(F.lit(0.0)))), VQ + "select x::int x, y::int y, z, round(case when v between -0.1 and 0.1 then v else 0 end, 6) v from vox")
register("vol_arithmetic", lambda s, d: _vox(X(s, d).withColumn("v", F.abs(F.col("v") * 3 - 0.5) / 2 + 1)), VQ + "select x::int x, y::int y, z, round(abs(v * 3 - 0.5) / 2 + 1, 6) v from vox")
register("vol_invert_normalize", lambda s, d: _vox(X(s, d).join(X(s, d).groupBy("z").agg(F.max("v").alias("hi"), F.min("v").alias("lo")), "z").withColumn("v", (F.col("hi") + F.col("lo") - F.col("v")) / F.col("hi"))), VQ + "select x::int x, y::int y, z, round((max(v) over (partition by z) + min(v) over (partition by z) - v) / max(v) over (partition by z), 6) v from vox")
_SHIFT = lambda s, d: V.voxels(s, d).withColumn("x", 7 - F.col("x"))
for _how, _rule in {
    "apply": "case when q > 0 then p else 0 end", "remove": "case when q > 0 then 0 else p end", "fill": "p * q", "merge": "greatest(p, q)", "difference": "case when (p > 0) <> (q > 0) then 1 else 0 end", "insert": "case when q > 0 then q else p end",
}.items():
    register(f"vol_mask_{_how}", lambda s, d, h=_how: _vox(VO.combine(X(s, d), _SHIFT(s, d), h)), VQ + f"select a.x::int x, a.y::int y, a.z, round({_rule}, 6)::double v from (select a.x, a.y, a.z, a.v p, b.v q from vox a join vox b on a.y = b.y and a.z = b.z and b.x = 7 - a.x) a")
register("vol_erode", lambda s, d: _vox(VO.erode(X(s, d))), _local("round(min(v), 6) v"))
register("vol_dilate", lambda s, d: _vox(VO.dilate(X(s, d))), _local("round(max(v), 6) v"))
_TWICE = VQ + ", e1 as (select x, y, z, {a}(v) v from " + _NB + " group by x, y, z) select a.x::int x, a.y::int y, a.z, round({b}(b.v), 6) v from e1 a join e1 b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) <= 1 group by a.x, a.y, a.z"
register("vol_open", lambda s, d: _vox(VO.opened(X(s, d))), _TWICE.format(a="min", b="max"))
register("vol_close", lambda s, d: _vox(VO.closed(X(s, d))), _TWICE.format(a="max", b="min"))
register("vol_gradient", lambda s, d: _vox(VO.gradient(X(s, d))), _local("round(max(v) - min(v), 6) v"))
register("vol_gradient_inner", lambda s, d: _vox(VO.gradient(X(s, d), kind="inner")), _local("round(any_value(own) - min(v), 6) v"))
register("vol_gradient_outer", lambda s, d: _vox(VO.gradient(X(s, d), kind="outer")), _local("round(max(v) - any_value(own), 6) v"))
register("vol_mean", lambda s, d: _vox(VO.mean(X(s, d))), _local("round(avg(v), 6) v"))
register("vol_median", lambda s, d: _vox(VO.median(X(s, d))), _local("round(median(v), 6) v"))
register("vol_gaussian", lambda s, d: _vox(VO.gaussian(X(s, d))), VQ + "select a.x::int x, a.y::int y, a.z, round(sum(b.v * exp(-(abs(a.x - b.x) + abs(a.y - b.y)) / 2.0)) / sum(exp(-(abs(a.x - b.x) + abs(a.y - b.y)) / 2.0)), 6) v from vox a join vox b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) <= 1 group by 1, 2, 3")
register("vol_stat_dispersion", lambda s, d: _vox(VO.dispersion(X(s, d)), "sd", "range", "less_mean"), _local("round(stddev_pop(v), 6) sd, round(max(v) - min(v), 6) as range, round(any_value(own) - avg(v), 6) less_mean"))
register("vol_laplacian", lambda s, d: _vox(VO.laplacian(X(s, d))), _local("round(sum(v) - count(*) * any_value(own), 6) v"))
register(
    "vol_hessian",
    lambda s, d: _vox(VO.hessian(X(s, d)), "low", "high"),
    VQ + ", h as (select a.x, a.y, a.z, sum(case when b.x - a.x in (1, -1) and b.y = a.y then b.v when b.x = a.x and b.y = a.y then -2 * b.v end) xx, sum(case when b.y - a.y in (1, -1) and b.x = a.x then b.v when b.x = a.x and b.y = a.y then -2 * b.v end) yy, sum(case when (b.x - a.x) * (b.y - a.y) = 1 then b.v when (b.x - a.x) * (b.y - a.y) = -1 then -b.v end) / 4 xy, count(*) n from vox a join vox b on a.z = b.z and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3) select x::int x, y::int y, z, round((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy), 6) low, round((xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy), 6) high from h where n = 9",
)
register("vol_sharpen", lambda s, d: _vox(VO.sharpen(X(s, d))), _local("round(case when any_value(own) - min(v) <= max(v) - any_value(own) then min(v) else max(v) end, 6) v"))
_BIN = f"with vx as (select e % 8 x, e // 8 y, tf z, case when x > 0 then 1.0 else 0.0 end v from (select vec_id tf, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 e from embeddings)), nb as (select a.x::int x, a.y::int y, a.z, a.v own, b.v from vx a join vx b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) <= 1) "
_B = lambda s, d: VO.binarise(X(s, d))
register("vol_binarize", lambda s, d: _B(s, d).select("x", "y", "z", "v"), _BIN + "select x::int x, y::int y, z, v::double v from vx")
register("vol_neighbors", lambda s, d: VO.count_rule(_B(s, d), 2).select("x", "y", "z", "v"), _BIN + "select x, y, z, case when any_value(own) > 0 and sum(v) - any_value(own) >= 2 then 1.0 else 0.0 end::double v from nb group by 1, 2, 3")
register("vol_neighbors_add", lambda s, d: VO.count_rule(_B(s, d), 3, add=True).select("x", "y", "z", "v"), _BIN + "select x, y, z, case when any_value(own) > 0 or sum(v) - any_value(own) >= 3 then 1.0 else 0.0 end::double v from nb group by 1, 2, 3")
register("vol_binary_median", lambda s, d: _vox(VO.median(_B(s, d))), _BIN + "select x, y, z, round(median(v), 6)::double v from nb group by 1, 2, 3")
register("vol_fullness", lambda s, d: _vox(VO.fullness(X(s, d))), _BIN + "select x, y, z, round(avg(v), 6)::double v from nb group by 1, 2, 3")
register("vol_entropy", lambda s, d: _vox(VO.entropy(X(s, d), 4, -0.4, 0.4), "entropy", "mode"))
register("vol_symmetrize", lambda s, d: _vox(VO.symmetrise(X(s, d), "x", 8)), VQ + "select a.x::int x, a.y::int y, a.z, round(greatest(a.v, b.v), 6) v from vox a join vox b on a.y = b.y and a.z = b.z and b.x = 7 - a.x")
register("vol_flip", lambda s, d: _vox(VO.flip(X(s, d), "y", 8)), VQ + "select x::int x, 7 - y::int y, z, round(v, 6) v from vox")
register("vol_template_brain", lambda s, d: VO.template_brain(X(s, d), ("x", "y")).select("x", "y", r6("v").alias("v")), VQ + "select x::int x, y::int y, round(avg(v), 6) v from vox group by 1, 2")
register("vol_histogram_equalize", lambda s, d: X(s, d).select("x", "y", "z", r6(F.cume_dist().over(W.partitionBy("z").orderBy("v"))).alias("v")), VQ + "select x::int x, y::int y, z, round(cume_dist() over (partition by z order by v), 6) v from vox")
register("vol_tissues_merge", lambda s, d: VO.tissues([_B(s, d), VO.binarise(X(s, d), 0.1)]), VQ + "select x::int x, y::int y, z, case when v > 0.1 then 2.0 else 1.0 end::double v from vox where v > 0")
register("vol_bias_field", lambda s, d: VO.bias_field(X(s, d).withColumn("v", F.abs("v"))).select("x", "y", "z", r6("v").alias("v")), VQ + "select x::int x, y::int y, z, round(abs(v) / avg(abs(v)) over (partition by z, x // 4, y // 4), 6) v from vox")
register("vol_resample", lambda s, d: _vox(VO.resample(X(s, d), 2)), VQ + "select (x // 2)::int x, (y // 2)::int y, z, round(avg(v), 6) v from vox group by 1, 2, 3")
register("vol_isosurface", lambda s, d: VO.isosurface_area(X(s, d), 0.0).select("z", F.col("faces").cast("long").alias("faces")), _BIN + "select a.z, count(*) faces from vx a join vx b on a.z = b.z and a.v <> b.v and ((b.x = a.x + 1 and b.y = a.y) or (b.y = a.y + 1 and b.x = a.x)) group by 1")
register("vol_thinning", lambda s, d: VO.thin(_B(s, d)))


def _tissues(s, d):
    bins = X(s, d).groupBy(F.round("v", 2).alias("v")).count().collect()  # one row per grey level
    return VO.classify(X(s, d), VO.tissue_levels(sorted((r["v"], r["count"]) for r in bins))).select("x", "y", "z", "tissue")


register("vol_tissues_kmeans", _tissues)


def _coregistered(s, d):
    a = X(s, d)
    return s.createDataFrame([VO.coregister(a, a.withColumn("x", F.col("x") + 1))], "dx int, dy int")


register("vol_coregister", _coregistered)
_TAL = "case when z >= 0 then {a} else {b} end"
register(
    "vol_talairach",
    lambda s, d: (lambda g: g.select("x", "y", "z", *[r6(c).alias(n) for c, n in zip(VO.talairach(F.col("x") - 2, F.col("y") - 2, F.col("z") - 2), ("tx", "ty", "tz"))]))(_grid(s)),
    "with g as (select x::int x, y::int y, z::int z from (select unnest(range(4)) x), (select unnest(range(4)) y), (select unnest(range(4)) z)) select x, y, z, round(0.99 * (x - 2), 6)::double tx, round(0.9688 * (y - 2) + case when z >= 2 then 0.046 else 0.042 end * (z - 2), 6)::double ty, round(-0.0485 * (y - 2) + case when z >= 2 then 0.9189 else 0.839 end * (z - 2), 6)::double tz from g",
)

# --- points: each map's full triples of components as 21 points ------------------------------------------------------------------------------------------------------------------------


def _points(s, d, most=63):
    long = V.maps_long(s, d).filter(F.col("e") < most)
    pick = lambda k: F.max(F.when(F.col("e") % 3 == k, F.col("x")))
    return long.groupBy(F.col("tf").alias("set_id"), F.floor(F.col("e") / 3).cast("int").alias("idx")).agg(pick(0).alias("x"), pick(1).alias("y"), pick(2).alias("z"))


_PTS = f"{V.LONG}, pts as (select tf set_id, (e // 3)::int idx, max(x) filter (where e % 3 = 0) x, max(x) filter (where e % 3 = 1) y, max(x) filter (where e % 3 = 2) z from maps_long where e < 63 group by 1, 2)"
_MOVE = [[0, -2, 0, 1], [2, 0, 0, 0], [0, 0, 2, -3], [0, 0, 0, 1]]
register("geo_transform", lambda s, d: G.transform(_points(s, d), _MOVE).select("set_id", "idx", *[r6(c).alias(c) for c in "xyz"]), f"with {_PTS} select set_id, idx, round(-2 * y + 1, 6) x, round(2 * x, 6) y, round(2 * z - 3, 6) z from pts")
register("geo_swap", lambda s, d: G.swap(_points(s, d), "x", "z").select("set_id", "idx", *[r6(c).alias(c) for c in "xyz"]), f"with {_PTS} select set_id, idx, round(z, 6) x, round(y, 6) y, round(x, 6) z from pts")
register("geo_bounding_box", lambda s, d: G.bounding_box(_points(s, d)).select("set_id", *[r6(f"{c}_{n}").alias(f"{c}_{n}") for c in "xyz" for n in ("min", "max")]), f"with {_PTS} select set_id, " + ", ".join(f"round({n}({c}), 6) {c}_{n}" for c in "xyz" for n in ("min", "max")) + " from pts group by 1")
register("geo_distances", lambda s, d: G.spread(_points(s, d)).select("set_id", "idx", r6("distance").alias("distance")), f"with {_PTS}, m as (select idx, avg(x) x, avg(y) y, avg(z) z from pts group by 1) select set_id, p.idx, round(sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2 + (p.z - m.z) ** 2), 6) distance from pts p join m on p.idx = m.idx")
register("geo_variation", lambda s, d: G.variation(_points(s, d)).select("set_id", r6("average").alias("average"), r6("cov").alias("cov"), "unfit"), f"with {_PTS}, m as (select idx, avg(x) x, avg(y) y, avg(z) z from pts group by 1), q as (select set_id, sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2 + (p.z - m.z) ** 2) d from pts p join m on p.idx = m.idx) select set_id, round(avg(d), 6) average, round(100 * stddev_samp(d) / avg(d), 6) cov, 100 * stddev_samp(d) / avg(d) > 52 unfit from q group by 1")
register("geo_pair_distances", lambda s, d: G.pair_distances(_points(s, d)).select("set_id", "a", "b", r6("d").alias("d")), f"with {_PTS} select p.set_id, p.idx a, q.idx b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) d from pts p join pts q on p.set_id = q.set_id and p.idx < q.idx")


def _near(s, d):
    """Every point glued to the nearest two of the mean points, within 0.15."""
    p = _points(s, d).select((F.col("set_id") * 100 + F.col("idx")).alias("idx"), "x", "y", "z")
    t = _points(s, d).groupBy("idx").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return G.nearest(p, t, 2, 0.15).select("idx", "near", r6("d").alias("d"))


register("geo_nearest", _near, f"with {_PTS}, t as (select idx, avg(x) x, avg(y) y, avg(z) z from pts group by 1), j as (select p.set_id * 100 + p.idx idx, t.idx near, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) d from pts p, t) select idx, near, round(d, 6) d from (select *, row_number() over (partition by idx order by round(d, 9), near) n from j) where n <= 2")
register("geo_template_electrodes", lambda s, d: G.template(_points(s, d)).select("idx", *[r6(c).alias(c) for c in "xyz"]))
register("geo_downsample", lambda s, d: G.thin_out(_points(s, d), 6).select("set_id", "idx"))
_LAND = G.from_landmarks((2, 0, 0), (0, 2, 0), (0, 0, 2), (0, -2, 0), (-2, 0, 0))
register("geo_landmarks", lambda s, d: G.transform(_points(s, d), _LAND).select("set_id", "idx", *[r6(c).alias(c) for c in "xyz"]), f"with {_PTS} select set_id, idx, round(x / 2, 6) x, round(y / 2, 6) y, round(z / 2, 6) z from pts")
register(
    "roi_from_atlas",
    lambda s, d: _points(s, d).withColumn("roi", F.concat_ws("", *[F.when(F.round(F.col(c) * 5).cast("int") > 0, "+").otherwise("-") for c in "xyz"])).groupBy("set_id", "roi").agg(F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("members")),
    f"with {_PTS} select set_id, roi, array_to_string(list_sort(list(idx)), ',') members from (select set_id, idx, case when round(x * 5) > 0 then '+' else '-' end || case when round(y * 5) > 0 then '+' else '-' end || case when round(z * 5) > 0 then '+' else '-' end roi from pts) group by 1, 2",
)
register("solution_points_grid", lambda s, d: X(s, d).filter("v > 0 and x % 2 = 0 and y % 2 = 0").select("x", "y", "z"), VQ + "select x::int x, y::int y, z from vox where v > 0 and x % 2 = 0 and y % 2 = 0")

# --- synthetic data -----------------------------------------------------------------------------------------------------------------------------------------------------------
register(
    "synth_oscillating",
    lambda s, d: s.range(2000).select(F.col("id").alias("tf"), *[(r6(F.sin(2 * math.pi * f * F.col("id") / 256) * a) + 0.0).alias(n) for n, f, a in (("alpha", 10.0, 3.0), ("theta", 6.0, 1.5))]),
    "select i tf, round(sin(2 * pi() * 10 * i / 256) * 3, 6) + 0.0::double alpha, round(sin(2 * pi() * 6 * i / 256) * 1.5, 6) + 0.0::double theta from (select unnest(range(2000)) i)",
)
register("synth_noise", lambda s, d: s.range(0, 2000, 1, 4).select(F.col("id").alias("tf"), F.randn(7).alias("value")))
register("synth_segments", lambda s, d: s.range(0, 640).select(F.col("id").alias("tf"), (F.floor(F.col("id") / 64) % 4).cast("int").alias("k")).join(V.templates(s, d), "k").select("tf", "k", r6(M.gfp(F.col("t"))).alias("gfp")), f"with {V.TEMPLATES}, g as (select k, stddev_pop(x) g from tpl group by 1) select i tf, g.k, round(g, 6) gfp from (select unnest(range(640)) i) join g on g.k = i // 64 % 4")

# --- streams: our own addition; the queries run the batch form of the same plan, tests hold both against each other ----------------------------------------------------------------
register("stream_tumbling", lambda s, d: ST.tumbling(ST.timed(V.table(s, d, "events")), "1 day").select("start", "event_type", "n", r6("total").alias("total")), "select date_trunc('day', ts)::timestamp \"start\", event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
register("stream_sliding", lambda s, d: ST.sliding(ST.timed(V.table(s, d, "events")), "2 days", "1 day").select("start", "n"), "select w::timestamp \"start\", count(*) n from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) w from events) group by 1")
register(
    "stream_session",
    lambda s, d: ST.sessions(ST.timed(V.table(s, d, "events")), "2 hours").select("user_id", "start", "n"),
    "with g as (select *, sum(st) over (partition by user_id order by ts, event_id) k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end st from events)) select user_id, min(ts)::timestamp \"start\", count(*) n from g group by user_id, k",
)
register("stream_causal_filter", lambda s, d: ST.causal_batch(V.table(s, d, "events"), 0.2).select("user_id", "event_id", r6("y").alias("y")))
