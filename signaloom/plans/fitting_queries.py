"""Queries over spectra, micro-states and statistics, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M
from ..operators import epochs as EP
from ..operators import filters as FL
from ..operators import frequency as FR
from ..operators import microstates as MS
from ..operators import statistics as ST
from ..operators import tracks as T
from . import views as V
from .catalog import register
from .signal_queries import r6

# --- spectra: windows of 16 frames, step 8, of each recording -----------------------------------------------------------------------------------------------------------------
PI = math.pi  # no power of two-decimal data over pi ends in a five: rounding has no ties
N, STEP = 16, 8
BY = ("rec",)


def _win(s, d):
    return FR.complete(FR.windows(V.samples(s, d), N, STEP, BY), N, BY)


_W = V.SAMPLES + f", sp as (select rec, unnest(range(greatest(0, ceil((tf - {N} + 1) / {STEP}))::bigint, (tf // {STEP})::bigint + 1)) win, tf, value from samples), wi as (select rec, win, tf - win * {STEP} i, value from sp), wn as (select * from wi where (rec, win) in (select (rec, win) from wi group by rec, win having count(*) = {N}))"
_DFT = _W + f", dft as (select rec, win, f, sum(value * cos(2 * pi() / {N} * ((f * i) % {N}))) re, -sum(value * sin(2 * pi() / {N} * ((f * i) % {N}))) im from wn, (select unnest(range(0, {N // 2 + 1})) f) group by 1, 2, 3), po as (select *, re * re + im * im power from dft)"


def _dft(s, d, **k):
    return FR.dft(_win(s, d), N, range(N // 2 + 1), by=BY, **k)


r3 = lambda c: F.round(c, 3)
register("freq_dft_power", lambda s, d: _dft(s, d).select("rec", "win", "f", F.round(F.col("power") / PI, 3).alias("power")), f"with {_DFT} select rec, win, f::int f, round(power / pi(), 3) power from po")
register("freq_range_complex", lambda s, d: _dft(s, d, rescale="parseval").select("rec", "win", "f", F.round("re", 7).alias("re"), F.round("im", 7).alias("im")).filter("f between 1 and 3"), f"with {_DFT} select rec, win, f::int f, round(re / 4, 7) re, round(im / 4, 7) im from po where f between 1 and 3")
register(
    "freq_hanning",
    lambda s, d: FR.dft(_win(s, d).withColumn("x", FR.hanning("x", N)), N, [1, 2, 5], by=BY).select("rec", "win", "f", r3("power").alias("power")),
    f"with {_W}, hn as (select rec, win, f, sum(h * cos(2 * pi() / {N} * ((f * i) % {N}))) re, -sum(h * sin(2 * pi() / {N} * ((f * i) % {N}))) im from (select *, value * (0.5 - 0.5 * cos(2 * pi() * i / {N - 1})) h from wn), (select unnest([1, 2, 5]) f) group by 1, 2, 3) select rec, win, f::int f, round(re * re + im * im, 3) power from hn",
)
register("freq_windows_sequence", lambda s, d: _win(s, d).select("rec", "win", F.size("x").alias("n"), r6(M.mean(F.col("x"))).alias("mean")), f"with {_W} select rec, win, count(*)::int n, round(avg(value), 6) mean from wn group by 1, 2")
register("freq_windows_average", lambda s, d: _dft(s, d).groupBy("rec", "f").agg(F.round(F.avg("power") / PI, 3).alias("power")), f"with {_DFT} select rec, f::int f, round(avg(power) / pi(), 3) power from po group by 1, 2")
register("freq_fft", lambda s, d: FR.fft(_win(s, d), N, BY).select("rec", "win", "f", F.round(F.col("power") / PI, 3).alias("power")), f"with {_DFT} select rec, win, f::int f, round(power / pi(), 3) power from po")
register(
    "freq_bands",
    lambda s, d: FR.bands(_dft(s, d), "1-3; 3-5; 6-8", ("rec", "win")).select("rec", "win", "band", F.round(F.col("power") / PI, 3).alias("power")),
    f"with {_DFT} select rec, win, band, round(avg(power) / pi(), 3) power from po join (values ('1-3', 1, 3), ('3-5', 3, 5), ('6-8', 6, 8)) b(band, lo, hi) on f between lo and hi group by 1, 2, 3",
)
register("freq_normalized_power", lambda s, d: FR.normalised(_dft(s, d).filter("f > 0"), ("rec", "win")).select("rec", "win", "f", r6("power").alias("power")), f"with {_DFT} select rec, win, f::int f, round(power / sum(power) over (partition by rec, win), 6) power from po where f > 0")
_GRID = FR.log_grid(4, 1.0, 8.0)


def _log_grid(s, d):
    grid = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(x).alias("hz")) for i, x in enumerate(_GRID)])
    near = _dft(s, d).filter("f > 0").groupBy("rec", "f").agg(F.avg("power").alias("power")).withColumn("m", F.explode(grid))
    best = F.min(F.struct(F.round(F.abs(F.col("f") - F.col("m.hz")), 9).alias("d"), "f", "power")).alias("b")
    return near.groupBy("rec", F.col("m.g").alias("g")).agg(best).select("rec", "g", F.col("b.f").alias("f"), F.round(F.col("b.power") / PI, 3).alias("power"))


register(
    "freq_log_grid",
    _log_grid,
    f"with {_DFT}, m as (select rec, f, avg(power) power from po where f > 0 group by 1, 2), j as (select rec, g, f, power, row_number() over (partition by rec, g order by round(abs(f - hz), 9), f) n from m, (values {', '.join(f'({i}, {x!r}::double)' for i, x in enumerate(_GRID))}) v(g, hz)) select rec, g, f::int f, round(power / pi(), 3) power from j where n = 1",
)
register(
    "freq_coherence",
    lambda s, d: FR.coherence(_dft(s, d), _dft(s, d).withColumn("win", F.col("win") + 1), ("rec", "win")).select("f", r6("coherence").alias("coherence")),
    f"with {_DFT}, c as (select a.f, sum(a.re * b.re + a.im * b.im) cr, sum(a.im * b.re - a.re * b.im) ci, sum(a.power) pa, sum(b.power) pb from po a join po b on a.rec = b.rec and a.win = b.win + 1 and a.f = b.f group by 1) select f::int f, round((cr * cr + ci * ci) / (pa * pb), 6) coherence from c",
)
register(
    "freq_exclude_markers",
    lambda s, d: _win(s, d).select("rec", "win").join(FR.windows(V.samples(s, d).filter("track = 'error'"), N, STEP, BY).select("rec", "win"), ["rec", "win"], "left_anti"),
    f"with {_W} select distinct rec, win from wn where (rec, win) not in (select (rec, win) from sp join samples using (rec, tf) where track = 'error')",
)
register("freq_split", lambda s, d: _dft(s, d).filter("f = 3").select("rec", "win", F.round(F.col("power") / PI, 3).alias("power")), f"with {_DFT} select rec, win, round(power / pi(), 3) power from po where f = 3")
register(
    "freq_merge",
    lambda s, d: FR.merge({8.0: T.interval(V.samples(s, d), 0, 5).select("rec", "tf", "value"), 12.0: T.interval(V.samples(s, d), 6, 9).select("rec", "tf", "value")}),
    f"with {V.SAMPLES} select rec, tf, value, case when tf <= 5 then 8.0 else 12.0 end::double f from samples where tf <= 9",
)
register("freq_stransform", lambda s, d: FR.s_transform(V.samples(s, d), [0, 1, 2, 4], ("rec",)).select("rec", "tf", "f", r6("re").alias("re"), r6("im").alias("im")))

# --- recursive filters ------------------------------------------------------------------------------------------------------------------------------------------------------
for _name, _kind in (("filter_butterworth_high", "high"), ("filter_butterworth_low", "low")):
    register(_name, lambda s, d, k=_kind: FL.apply(V.samples(s, d), FL.butterworth(k, 4, 5.0, 50.0), causal=False, by=("rec",)).withColumn("value", r6("value")))
register("filter_causal", lambda s, d: FL.apply(V.samples(s, d), FL.butterworth("low", 2, 5.0, 50.0), by=("rec",)).withColumn("value", r6("value")))
register("filter_notch", lambda s, d: FL.apply(V.samples(s, d), FL.notches(10.0, 50.0), by=("rec",)).withColumn("value", r6("value")))


def _neighbours(s):
    """Electrodes on an 8 by 8 grid, each with itself and up to four beside it."""
    e = s.range(64).select(F.col("id").cast("int").alias("e"))
    off = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    n = e.withColumn("o", F.explode(off)).select("e", (F.col("e") % 8 + F.col("o.a")).alias("x"), (F.floor(F.col("e") / 8) + F.col("o.b")).alias("y"))
    return n.filter("x between 0 and 7 and y between 0 and 7").select("e", (F.col("x") + 8 * F.col("y")).cast("int").alias("near"))


register(
    "filter_spatial",
    lambda s, d: FL.spatial(V.maps_long(s, d).select("tf", "e", "x"), _neighbours(s)).select("tf", "e", r6("x").alias("x")),
    f"with {V.LONG} select a.tf, a.e, round(median(b.x), 6) x from maps_long a join maps_long b on a.tf = b.tf and abs(a.e % 8 - b.e % 8) + abs(a.e // 8 - b.e // 8) <= 1 group by 1, 2",
)

# --- fitting ----------------------------------------------------------------------------------------------------------------------------------------------------------------
P = f"with {V.FIT} "


REC = 256  # consecutive maps of a recording


def _fits(s, d):
    return MS.correlations(V.maps(s, d), V.templates(s, d))


def _labels(s, d, least=None):
    return MS.fitted(V.maps(s, d), V.templates(s, d), least).drop("label").withColumn("rec", F.floor(F.col("tf") / REC))


def _named(df, *names):
    return df.select(*[r6(n).alias(n) if t == "double" else n for n, t in df.dtypes if not names or n in names])


register("fit_labels", lambda s, d: _named(_labels(s, d), "tf", "seg", "corr", "gfp"), P + "select tf, seg, round(corr, 6) corr, round(g, 6) gfp from lab")
register("fit_noncompetitive", lambda s, d: _fits(s, d).select("tf", "k", r6("corr").alias("corr")), P + "select tf, k, round(c, 6) corr from cor")
register("fit_low_correlation", lambda s, d: _labels(s, d, 0.3).select("tf", "seg"), P + "select tf, case when round(abs(corr), 9) >= 0.3 then seg end seg from lab")
_WS = "w as (select seg, min(tf) first_onset, max(tf) last_offset, count(*) n_tf, avg(abs(corr)) mean_corr, sum(power(g * corr, 2)) / any_value(pw) gev, sum(tf * g) / sum(g) tf_centroid, max(round(abs(corr), 9)) best_corr, max(round(g, 9)) max_gfp, avg(g) mean_gfp, count(*) / any_value(fr) coverage from lab, (select sum(g * g) pw, count(*) fr from lab) group by seg), b1 as (select seg, tf tf_best_corr, g gfp_best_corr from (select *, row_number() over (partition by seg order by round(abs(corr), 9) desc, tf) n from lab) where n = 1), b2 as (select seg, tf tf_max_gfp from (select *, row_number() over (partition by seg order by round(g, 9) desc, tf) n from lab) where n = 1)"
_SHEET = {
    "fit_worksheet": ["first_onset", "last_offset", "n_tf", "mean_corr", "gev", "tf_centroid", "best_corr", "tf_best_corr", "gfp_best_corr", "max_gfp", "mean_gfp", "tf_max_gfp", "coverage"],
    "fit_onset_offset": ["first_onset", "last_offset", "n_tf"],
    "fit_best_correlation": ["mean_corr", "best_corr", "tf_best_corr", "gfp_best_corr"],
    "fit_gfp_variables": ["max_gfp", "mean_gfp", "tf_max_gfp"],
    "fit_coverage": ["coverage", "tf_centroid"],
    "map_gev_per_cluster": ["gev"],
}
_INT = {"first_onset", "last_offset", "n_tf", "tf_best_corr", "tf_max_gfp"}
for _name, _cols in _SHEET.items():
    register(_name, lambda s, d, c=_cols: _named(MS.worksheet(_labels(s, d)), "seg", *c), P + f", {_WS} select seg, {', '.join(c if c in _INT else f'round({c}, 6) {c}' for c in _cols)} from w join b1 using (seg) join b2 using (seg)")
register("map_gev_total", lambda s, d: _labels(s, d).agg(r6(F.sum(F.pow(F.col("gfp") * F.col("corr"), 2)) / F.sum(F.col("gfp") * F.col("gfp"))).alias("gev")), P + "select round(sum(power(g * corr, 2)) / sum(g * g), 6) gev from lab")
register(
    "map_cross_validation",
    lambda s, d: _labels(s, d).agg((F.sum(64 * F.col("gfp") * F.col("gfp") * (1 - F.col("corr") * F.col("corr"))) / (F.count("*") * 63)).alias("s2")).select(r6(F.col("s2") * (63 / (63 - 10)) ** 2).alias("cv")),
    P + "select round(sum(64 * g * g * (1 - corr * corr)) / (count(*) * 63) * power(63.0 / 53, 2), 6) cv from lab",
)
register(
    "fit_worksheet_wide",
    lambda s, d: V.maps(s, d).select("tf", "label").join(_labels(s, d), "tf").groupBy("label").pivot("seg", list(range(10))).agg(F.count("tf")).na.fill(0),
    P + "select e.label, " + ", ".join(f'count(*) filter (where seg = {k}) as "{k}"' for k in range(10)) + " from lab join embeddings e on e.vec_id = lab.tf group by 1",
)
_SEGS = "si as (select *, sum(n) over (partition by rec order by tf) run from (select tf // 256 rec, tf, seg, case when seg is not distinct from lag(seg) over (partition by tf // 256 order by tf) then 0 else 1 end n from lab)), sg as (select rec, run, any_value(seg) seg, min(tf) from_tf, max(tf) to_tf, count(*) n from si group by rec, run)"
register("fit_mean_duration", lambda s, d: MS.durations(_labels(s, d)).select("seg", "segments", r6("mean_duration").alias("mean_duration")), P + f", {_SEGS} select seg, count(*) segments, round(avg(n), 6) mean_duration from sg group by 1")
register("fit_density", lambda s, d: MS.durations(_labels(s, d)).select("seg", r6("density").alias("density")), P + f", {_SEGS} select seg, round(count(*) / (select sum(n) from sg), 6) density from sg group by 1")
for _name, _ahead in (("fit_markov", 1), ("fit_markov_two", 2)):
    register(
        _name,
        lambda s, d, a=_ahead: MS.markov(_labels(s, d), a).select("seg", "next", "n", r6("p").alias("p")),
        P + f", {_SEGS}, mv as (select seg, lead(seg, {_ahead}) over (partition by rec order by from_tf) nx from sg) select seg, nx as next, count(*) n, round(count(*) / sum(count(*)) over (partition by seg), 6) p from mv where nx is not null group by 1, 2",
    )
register("fit_duration_histogram", lambda s, d: MS.segments(_labels(s, d)).groupBy("seg", F.col("n").alias("frames")).agg(F.count("*").alias("n")), P + f", {_SEGS} select seg, n frames, count(*) n from sg group by 1, 2")
register("fit_joint_probability", lambda s, d: MS.markov(_labels(s, d)).select("seg", "next", r6(F.col("n") / F.sum("n").over(W.partitionBy())).alias("p")), P + f", {_SEGS}, mv as (select seg, lead(seg) over (partition by rec order by from_tf) nx from sg) select seg, nx as next, round(count(*) / sum(count(*)) over (), 6) p from mv where nx is not null group by 1, 2")
register(
    "fit_background_normalized",
    lambda s, d: _labels(s, d).withColumn("bg", F.percentile("gfp", F.lit(0.5)).over(W.partitionBy("rec"))).select("tf", r6(F.col("gfp") / F.col("bg")).alias("gfp")),
    P + "select tf, round(g / median(g) over (partition by tf // 256), 6) gfp from lab",
)
register(
    "scan_template",
    lambda s, d: _fits(s, d).filter((F.col("k") == 3) & (F.round("corr", 9) >= 0.2)).select("tf", r6("corr").alias("corr")),
    P + "select tf, round(c, 6) corr from cor where k = 3 and round(c, 9) >= 0.2",
)

# --- segmentation -------------------------------------------------------------------------------------------------------------------------------------------------------------
register(
    "seg_gfp_peaks",
    lambda s, d: MS.gfp_peaks(V.maps(s, d).select("label", "tf", M.gfp(F.col("v")).alias("gfp")), ("label",)).select("label", "tf"),
    f"with {V.LONG}, g as (select label, tf, stddev_pop(x) g from maps_long group by 1, 2) select label, tf from (select *, lag(g) over w b, lead(g) over w a from g window w as (partition by label order by tf)) where g > b and g > a",
)
register("seg_sequentialize", lambda s, d: MS.sequentialise(_labels(s, d)).select("seq", "from_tf", "to_tf", "seg"), P + f", {_SEGS} select row_number() over (partition by rec order by from_tf)::int seq, from_tf, to_tf, seg from sg")
register("seg_reorder", lambda s, d: _labels(s, d).groupBy("seg").agg(F.min("tf").alias("onset")).select("seg", F.row_number().over(W.partitionBy().orderBy("onset")).alias("place")), P + "select seg, row_number() over (order by min(tf))::int place from lab group by 1")
register(
    "seg_kmeans_one_iteration",
    lambda s, d: _labels(s, d).join(V.maps(s, d).select("tf", F.posexplode(M.average_reference(F.col("v"))).alias("e", "x")), "tf").groupBy("seg", "e").agg(r6(F.avg(F.signum("corr") * F.col("x"))).alias("x")),
    P + "select seg, e, round(avg(sign(corr) * x), 6) x from lab join ref using (tf) group by 1, 2",
)
register(
    "seg_dual_templates",
    lambda s, d: _labels(s, d).join(V.maps_long(s, d).select("tf", "e", "x"), "tf").groupBy("seg", "e").agg(r6(F.avg("x")).alias("x")),
    P + "select seg, m.e, round(avg(m.x), 6) x from lab join maps_long m using (tf) group by 1, 2",
)
register(
    "seg_synthetic",
    lambda s, d: _labels(s, d).join(V.templates(s, d), F.col("seg") == F.col("k")).select("tf", F.posexplode(M.scale(F.col("t"), F.signum("corr") * F.col("gfp") / M.gfp(F.col("t")))).alias("e", "x")).select("tf", "e", r6("x").alias("x")),
    P + ", tg as (select k, stddev_pop(x) g from tpl group by 1) select lab.tf, t.e, round(t.x * sign(lab.corr) * lab.g / tg.g, 6) x from lab join tpl t on t.k = lab.seg join tg on tg.k = lab.seg",
)
register(
    "seg_criteria_davies_bouldin",
    lambda s, d: _davies_bouldin(s, d),
    P + ", sc as (select seg, avg(1 - abs(corr)) s from lab group by 1), tt as (select a.k, b.k k2, abs(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))) c from tpl a join tpl b on a.e = b.e and a.k <> b.k group by 1, 2) select round(avg(r), 6) db from (select p.seg, max((p.s + q.s) / (1 - c)) r from tt join sc p on p.seg = tt.k join sc q on q.seg = tt.k2 group by 1)",
)


def _template_pairs(s, d):
    """Ten templates with each other: an equi-join on electrodes."""
    long = V.templates(s, d).select("k", F.posexplode("t").alias("e", "x"))
    other = long.select(F.col("k").alias("k2"), "e", F.col("x").alias("y"))
    sums = long.join(other, "e").filter("k <> k2").groupBy("k", "k2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return sums.select("k", "k2", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("c"))


def _davies_bouldin(s, d):
    spread = _labels(s, d).groupBy("seg").agg(F.avg(1 - F.abs("corr")).alias("s"))
    two = _template_pairs(s, d).join(spread.select(F.col("seg").alias("k"), F.col("s").alias("s1")), "k").join(spread.select(F.col("seg").alias("k2"), F.col("s").alias("s2")), "k2")
    worst = two.groupBy("k").agg(F.max((F.col("s1") + F.col("s2")) / (1 - F.abs("c"))).alias("r"))
    return worst.agg(r6(F.avg("r")).alias("db"))


register("seg_template_correlation", lambda s, d: _template_pairs(s, d).select("k", "k2", r6("c").alias("c")), f"with {V.TEMPLATES} select a.k, b.k k2, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) c from tpl a join tpl b on a.e = b.e and a.k <> b.k group by 1, 2")
register("seg_merge_correlated", lambda s, d: MS.merge_correlated(V.templates(s, d), 0.3))
register("seg_kmeans", lambda s, d: MS.cluster(V.maps(s, d), range(2, 5), 3).withColumn("gev", r6("gev")))
register("seg_taahc", lambda s, d: MS.cluster_taahc(V.maps(s, d), 2, 4))
register("seg_criteria", lambda s, d: _named(MS.criteria(V.maps(s, d), MS.cluster(V.maps(s, d), range(1, 6), 2))))
register("seg_metacriterion", lambda s, d: MS.criteria(V.maps(s, d), MS.cluster(V.maps(s, d), range(1, 6), 2)).groupBy("label").agg(F.max_by("k", "meta_criterion").alias("best_k")))
register("seg_smoothing", lambda s, d: MS.smooth(_labels(s, d), _fits(s, d).withColumn("rec", F.floor(F.col("tf") / REC)), 3, 0.5))
register("seg_reject_small", lambda s, d: MS.reject_small(_labels(s, d), 2))


register("seg_resampled_epochs", lambda s, d: EP.resampled(V.maps(s, d).select("label", "tf"), "label", 8, 0.95, least=20))

# --- statistics ---------------------------------------------------------------------------------------------------------------------------------------------------------------
_LI = lambda s, d: V.table(s, d, "lineitem")
_TT = "select {k}, count(*) filter (where {a}) n1, count(*) filter (where {b}) n2, (avg({v}) filter (where {a}) - avg({v}) filter (where {b})) / sqrt(((count(*) filter (where {a}) - 1) * var_samp({v}) filter (where {a}) + (count(*) filter (where {b}) - 1) * var_samp({v}) filter (where {b})) / (count(*) filter (where {a}) + count(*) filter (where {b}) - 2) * (1.0 / count(*) filter (where {a}) + 1.0 / count(*) filter (where {b}))) t from {f} group by 1"
_UNPAIRED = _TT.format(k="l_linestatus", a="l_returnflag = 'N'", b="l_returnflag <> 'N'", v="l_quantity", f="lineitem")


def _two(s, d):
    return V.table(s, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "F").otherwise("x").alias("g"), F.col("o_totalprice").alias("value"))


_TWO = _TT.format(k="o_orderpriority", a="o_orderstatus = 'F'", b="o_orderstatus <> 'F'", v="o_totalprice", f="orders")
register("stat_ttest_unpaired", lambda s, d: ST.t_unpaired(_two(s, d), ["o_orderpriority"], "g", "F", "x").select("o_orderpriority", "n1", "n2", r6("t").alias("t")), f"select o_orderpriority, n1, n2, round(t, 6) t from ({_TWO})")


def _pairs(s, d):
    g = _LI(s, d).groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("b"), F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("c"))
    return g.withColumn("part", F.col("l_suppkey") % 7).filter("a is not null and b is not null")


_PAIR = "pr as (select l_suppkey, l_suppkey % 7 part, avg(l_quantity) filter (where l_returnflag = 'A') a, avg(l_quantity) filter (where l_returnflag = 'R') b from lineitem group by 1 having a is not null and b is not null)"
register("stat_ttest_paired", lambda s, d: ST.t_paired(_pairs(s, d), ["part"], "a", "b").select("part", "n", r6("t").alias("t"), "df"), f"with {_PAIR} select part, count(*) n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) t, count(*) - 1 df from pr group by 1")
register("stat_p_values", lambda s, d: ST.t_paired(_pairs(s, d), ["part"], "a", "b").select("part", r6(ST.student_p(F.col("t"), F.col("df"))).alias("p")))
register("stat_randomization", lambda s, d: ST.randomised(_pairs(s, d), ["part"], "a", "b", "l_suppkey", 200).select("part", r6("m").alias("m"), r6("p").alias("p")))


def _tanova(s, d):
    long = V.maps_long(s, d).select(F.col("tf").alias("subject"), F.when(F.col("label") < 5, 0).otherwise(1).alias("grp"), "e", "x")
    return ST.topographic(long, "grp", 0, 1, 50).select(r6("dis").alias("dis"), r6("p").alias("p"))


register("stat_tanova", _tanova)


def _scores(s, d):
    """A made-up p for each supplier, as a share of a prime."""
    return V.table(s, d, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") * 7919) % 10007 / 10007).alias("p"))


_SCORES = "sc as (select s_suppkey, s_nationkey, ((s_suppkey * 7919) % 10007) / 10007 p from supplier)"
register("stat_bonferroni", lambda s, d: ST.bonferroni(_scores(s, d)).select("s_suppkey", r6("q").alias("q")), f"with {_SCORES} select s_suppkey, round(least(1, p * count(*) over ()), 6) q from sc")
register(
    "stat_fdr",
    lambda s, d: ST.false_discovery(_scores(s, d), by=("s_nationkey",)).select("s_suppkey", r6("q").alias("q")),
    f"with {_SCORES}, r as (select *, row_number() over (partition by s_nationkey order by p) k, count(*) over (partition by s_nationkey) n from sc) select s_suppkey, round(least(1, min(p * n / k) over (partition by s_nationkey order by p desc)), 6) q from r",
)
register("stat_p_output", lambda s, d: _scores(s, d).filter("p > 0").select("s_suppkey", *[r6(ST.shown(F.col("p"), h)).alias(h) for h in ("p", "one_minus", "minus_log")]), f"with {_SCORES} select s_suppkey, round(p, 6) p, round(1 - p, 6) one_minus, round(-log10(p), 6) minus_log from sc where p > 0")


def _min_duration(s, d):
    from ..operators import markers as MK

    return MK.lasting(_scores(s, d).select(F.floor(F.col("s_suppkey") / 100).alias("rec"), F.col("s_suppkey").alias("tf"), "p"), F.col("p") < 0.6, 3, 1_000_000).select("from_tf", "to_tf", "n")


register(
    "stat_min_duration",
    _min_duration,
    f"with {_SCORES}, r as (select *, sum(st) over (partition by s_suppkey // 100 order by s_suppkey) run from (select *, case when (p < 0.6) is not distinct from lag(p < 0.6) over (partition by s_suppkey // 100 order by s_suppkey) then 0 else 1 end st from sc)) select min(s_suppkey) from_tf, max(s_suppkey) to_tf, count(*) n from r where p < 0.6 group by s_suppkey // 100, run having count(*) >= 3",
)
register("stat_missing", lambda s, d: _LI(s, d).groupBy("l_returnflag").agg(F.count(F.nullif("l_discount", F.lit(0.0))).alias("n"), r6(F.avg(F.nullif("l_discount", F.lit(0.0)))).alias("m")), "select l_returnflag, count(nullif(l_discount, 0)) n, round(avg(nullif(l_discount, 0)), 6) m from lineitem group by 1")
register(
    "stat_gfp_normalized",
    lambda s, d: V.maps(s, d).select("label", "tf", M.gfp(F.col("v")).alias("g")).join(V.maps(s, d).groupBy("label").agg(F.avg(M.gfp(F.col("v"))).alias("mg")), "label").select("tf", r6(F.col("g") / F.col("mg")).alias("g")),
    f"with {V.LONG}, g as (select label, tf, stddev_pop(x) g from maps_long group by 1, 2) select tf, round(g / avg(g) over (partition by label), 6) g from g",
)
register(
    "stat_within_interval",
    lambda s, d: T.interval(V.samples(s, d), 5, 30).groupBy("rec").agg(r6(F.avg("value")).alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo")),
    f"with {V.SAMPLES} select rec, round(avg(value), 6) mean, max(value) hi, min(value) lo from samples where tf between 5 and 30 group by 1",
)
register("stat_csv_layout", lambda s, d: _pairs(s, d).select("l_suppkey", F.expr("stack(2, 'a', a, 'b', b) as (variable, value)")).withColumn("value", r6("value")), f"with {_PAIR} select l_suppkey, 'a' variable, round(a, 6) as value from pr union all select l_suppkey, 'b', round(b, 6) from pr")
register("stat_correlation", lambda s, d: _pairs(s, d).groupBy("part").agg(r6(F.corr("a", "b")).alias("c")), f"with {_PAIR} select part, case when not isnan(corr(a, b)) then round(corr(a, b), 6) end c from pr group by 1")  # none for one pair
