"""Queries over sessions, spectra of referenced maps, restricted fits, randomization and volume statistics, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps as M
from ..operators import frequency as FR
from ..operators import geometry as G
from ..operators import microstates as MS
from ..operators import sessions as SE
from ..operators import statistics as ST
from ..operators import volumes as VO
from . import views as V
from .catalog import register
from .signal_queries import r6

# --- sessions and sampling frequencies: users as recordings, of three sessions at 100, 150 and 200 Hz --------------------------------


def _recordings(s, d):
    session = F.col("user_id") % 3
    return V.table(s, d, "events").select(F.col("user_id").alias("rec"), session.cast("int").alias("session"), (100.0 + 50 * session).alias("hz")).distinct()


_REC = f"with {V.SAMPLES}, rc as (select distinct user_id rec, (user_id % 3)::int as session, 100.0::double + 50 * (user_id % 3) hz from events), ti as (select s.rec, s.tf, s.track, s.value, session, hz from samples s join rc using (rec))"
register(
    "session_time",
    lambda s, d: SE.timed(V.samples(s, d), _recordings(s, d)).select("rec", "tf", "session", r6("seconds").alias("seconds")),
    _REC + " select rec, tf, session, round(tf / hz, 6) as seconds from ti",
)
register(
    "session_average",
    lambda s, d: SE.per_session(V.samples(s, d), _recordings(s, d)).select("session", "track", "n", r6("mean").alias("mean")),
    _REC + " select session, track, count(*) n, round(avg(value), 6) mean from ti group by 1, 2",
)
register(
    "tracks_to_frequency",
    lambda s, d: SE.to_frequency(V.samples(s, d), _recordings(s, d), 70.0).select("rec", "tf", "value", "hz"),
    _REC + ", ra as (select *, greatest(1, floor(hz / 70 + 0.5))::bigint r from ti) select rec, tf // r as tf, value, hz / r as hz from ra where tf % r = 0",
)
register(
    "freq_downsample_to_highest",
    lambda s, d: SE.for_highest(V.samples(s, d), _recordings(s, d), 30.0).select("rec", "tf", "value", "hz"),
    _REC + ", ra as (select *, greatest(1, floor(hz / 60))::bigint r from ti) select rec, tf // r as tf, value, hz / r as hz from ra where tf % r = 0",
)

# --- spectra of maps after the average reference: windows of 16 frames, step 8, of each electrode -------------------------------------
_N, _STEP = 16, 8


def _referenced(s, d):
    long = V.maps(s, d).select("tf", F.posexplode(M.average_reference(F.col("v"))).alias("rec", "value"))
    win = FR.complete(FR.windows(long, _N, _STEP, ("rec",)), _N, ("rec",))
    return FR.dft(win, _N, [1, 3, 6], by=("rec",))


_RW = (
    f"with {V.REF}, sp as (select e rec, unnest(range(greatest(0, ceil((tf - {_N} + 1) / {_STEP}))::bigint, (tf // {_STEP})::bigint + 1)) win, tf, x from ref),"
    f" wi as (select rec, win, tf - win * {_STEP} i, x from sp), ok as (select rec, win from wi group by 1, 2 having count(*) = {_N}),"
    f" df as (select rec, win, f, sum(x * cos(2 * pi() / {_N} * ((f * i) % {_N}))) re, -sum(x * sin(2 * pi() / {_N} * ((f * i) % {_N}))) im"
    f" from wi join ok using (rec, win), (values (1), (3), (6)) fr(f) group by 1, 2, 3)"
)
register(
    "freq_reference_average",
    lambda s, d: _referenced(s, d).select("rec", "win", "f", r6("power").alias("power")),
    _RW + " select rec, win, f, round(re * re + im * im, 6) power from df",
)
register(
    "freq_amplitude_phase",
    lambda s, d: _referenced(s, d).select("rec", "win", "f", r6(F.sqrt("power")).alias("amplitude"), r6(F.cos(F.atan2("im", "re"))).alias("phase_cos"), r6(F.sin(F.atan2("im", "re"))).alias("phase_sin")),
    _RW + " select rec, win, f, round(sqrt(re * re + im * im), 6) amplitude, round(cos(atan2(im, re)), 6) phase_cos, round(sin(atan2(im, re)), 6) phase_sin from df",
)
register(
    "freq_reordered",
    lambda s, d: _referenced(s, d).groupBy("f", "win").agg(F.array_sort(F.collect_list(F.struct("rec", r6("power").alias("p")))).alias("l")).select("f", "win", F.posexplode(F.col("l.p")).alias("place", "power")),
    _RW + " select f, win, (row_number() over (partition by f, win order by rec) - 1)::int place, round(re * re + im * im, 6) power from df",
)

# --- fits restricted to given maps -----------------------------------------------------------------------------------------------------


def _given(s, d):
    fits = MS.correlations(V.maps(s, d), V.templates(s, d))
    return MS.label(fits.filter((F.col("label") % 2 == 0) == (F.col("k") < 5)))


register(
    "fit_restricted_maps",
    lambda s, d: _given(s, d).select("tf", "seg", r6("corr").alias("corr")),
    f"with {V.FIT}, gi as (select cor.*, row_number() over (partition by tf order by round(abs(c), 9) desc, k) n from cor join embeddings e on e.vec_id = cor.tf where (label % 2 = 0) = (k < 5))"
    " select tf, k seg, round(c, 6) corr from gi where n = 1",
)
register(
    "fit_consecutive_groups",
    lambda s, d: MS.label(MS.correlations(V.maps(s, d), V.templates(s, d)), ("label", "tf")).withColumn("part", F.floor(F.col("tf") / 256)).groupBy("label", "part", "seg").agg(F.count("*").alias("n"), r6(F.avg(F.abs("corr"))).alias("corr")),
    f"with {V.FIT} select label, tf // 256 part, seg, count(*) n, round(avg(abs(corr)), 6) corr from lab join embeddings e on e.vec_id = lab.tf group by 1, 2, 3",
)
register(
    "fit_correlation_course",
    lambda s, d: MS.correlations(V.maps(s, d), V.templates(s, d)).groupBy(F.floor(F.col("tf") / 50).alias("block"), "k").agg(r6(F.avg(F.abs("corr"))).alias("corr")),
    f"with {V.FIT} select tf // 50 block, k, round(avg(abs(c)), 6) corr from cor group by 1, 2",
)

# --- randomization of unpaired groups ---------------------------------------------------------------------------------------------------
_RUNS = 40
register(
    "stat_randomization_unpaired",
    lambda s, d: ST.randomised_unpaired(V.table(s, d, "customer").withColumn("g", F.col("c_mktsegment") == "BUILDING"), ["c_nationkey"], "g", "c_acctbal", "c_custkey", _RUNS).select("c_nationkey", r6("m").alias("m"), r6("p").alias("p")),
    f"with c as (select c_nationkey k, c_custkey id, c_acctbal v, c_mktsegment = 'BUILDING' g from customer), ru as (select *, unnest(range({_RUNS + 1})) run from c),"
    " ra as (select *, row_number() over (partition by k, run order by md5(id || '/' || run), id) place, sum(g::int) over (partition by k, run) n1 from ru),"
    " si as (select k, run, v, case when run = 0 then g else place <= n1 end a from ra),"
    " me as (select k, run, round(abs(avg(v) filter (where a) - avg(v) filter (where not a)), 9) m from si group by 1, 2),"
    " re as (select k, m from me where run = 0 and m is not null)"
    " select k c_nationkey, round(any_value(re.m), 6) m, round(avg(case when me.m >= re.m then 1.0 else 0.0 end), 6) p from me join re using (k) group by 1",
)

# --- volumes ------------------------------------------------------------------------------------------------------------------------------
_VQ = f"with {V.VOXELS}"
_NB = f"{_VQ}, nb as (select a.x::int x, a.y::int y, a.z, a.v own, b.v from vox a join vox b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) <= 1)"
register(
    "vol_histogram",
    lambda s, d: VO.histogram(V.voxels(s, d), -0.5, 0.5, 20),
    _VQ + " select z, least(19, greatest(0, floor((v + 0.5) / 0.05)))::int bin, count(*) n from vox group by 1, 2",
)
register(
    "vol_with_volume",
    lambda s, d: VO.with_volume(V.voxels(s, d), VO.flip(V.voxels(s, d), "x", 8)).select("x", "y", "z", *[r6(c).alias(c) for c in ("added", "subtracted", "multiplied", "divided")]),
    _VQ + " select a.x::int x, a.y::int y, a.z, round(a.v + b.v, 6) added, round(a.v - b.v, 6) subtracted, round(a.v * b.v, 6) multiplied, round(a.v / nullif(b.v, 0), 6) divided from vox a join vox b on a.y = b.y and a.z = b.z and b.x = 7 - a.x",
)
_STATS = ("cov", "snr", "less_median", "mad", "skewness", "kurtosis", "low", "high")
register(
    "vol_stat_all",
    lambda s, d: VO.dispersion(V.voxels(s, d)).select("x", "y", "z", *[F.round(c, 4).alias(c) for c in _STATS]),
    _NB + ", me as (select x, y, z, avg(v) m, median(v) md, stddev_pop(v) sd from nb group by 1, 2, 3)"
    " select x, y, z, round(any_value(sd) / nullif(abs(any_value(m)), 0), 4) cov, round(any_value(m) / nullif(any_value(sd), 0), 4) snr, round(any_value(own) - any_value(md), 4) less_median,"
    " round(median(abs(v - md)), 4) mad, round(avg(power((v - m) / nullif(sd, 0), 3)), 4) skewness, round(avg(power((v - m) / nullif(sd, 0), 4)) - 3, 4) kurtosis, round(min(v), 4) low, round(max(v), 4) high"
    " from nb join me using (x, y, z) group by 1, 2, 3",
)
register(
    "vol_gaussian_anisotropic",
    lambda s, d: VO.gaussian_by_axis(V.voxels(s, d), (0.8, 1.6, 1.0)).select("x", "y", "z", r6("v").alias("v")),
    _VQ + ", w as (select a.x, a.y, a.z, b.v, exp(-(power(a.x - b.x, 2) / (2 * 0.64) + power(a.y - b.y, 2) / (2 * 2.56))) w from vox a join vox b on a.z = b.z and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1)"
    " select x::int x, y::int y, z, round(sum(v * w) / sum(w), 6) v from w group by x, y, z",
)
_REACH = (
    "with recursive vx as materialized (select e % 8 x, e // 8 y, tf z from (select vec_id tf, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 e from embeddings) where v > 0),"
    " lk as materialized (select a.z, a.y * 8 + a.x a, b.y * 8 + b.x b from vx a join vx b on a.z = b.z and abs(a.x - b.x) + abs(a.y - b.y) = 1),"
    " rc(z, a, b) as (select z, y * 8 + x, y * 8 + x from vx union select rc.z, rc.a, lk.b from rc join lk on lk.z = rc.z and lk.a = rc.b),"
    " rg as materialized (select z, a, min(b) root from rc group by 1, 2)"
)
_NAME = "(root % 8) || ',' || (root // 8) || ',' || z"
register(
    "vol_biggest_region",
    lambda s, d: VO.biggest(VO.regions(VO.binarise(V.voxels(s, d)))).select("x", "y", "z", F.concat_ws(",", "region.x", "region.y", "region.z").alias("region")),
    _REACH + f", sz as (select z, root, row_number() over (partition by z order by count(*) desc, root) n from rg group by 1, 2) select (a % 8)::int x, (a // 8)::int y, z, {_NAME} region from rg join sz using (z, root) where n = 1",
)
register(
    "vol_compact_region",
    lambda s, d: VO.compactness(VO.regions(VO.binarise(V.voxels(s, d)))).select(F.concat_ws(",", "region.x", "region.y", "region.z").alias("region"), "n", r6("inside").alias("inside")),
    _REACH + f", nr as (select z, a, count(b) k from rg left join lk using (z, a) group by 1, 2) select {_NAME} region, count(*) n, round(sum(k + 1) / (count(*) * 5.0), 6) inside from rg join nr using (z, a) group by z, root",
)
register(
    "vol_most_compact_region",
    lambda s, d: VO.most_compact(VO.compactness(VO.regions(VO.binarise(V.voxels(s, d)))), 1, 4).select("z", F.concat_ws(",", "region.x", "region.y", "region.z").alias("region"), "n"),
    _REACH + f", nr as (select z, a, count(b) k from rg left join lk using (z, a) group by 1, 2), cp as (select z, root, count(*) n, round(sum(k + 1) / (count(*) * 5.0), 9) i from rg join nr using (z, a) group by 1, 2 having count(*) >= 4)"
    f" select z, {_NAME} region, n from (select *, row_number() over (partition by z order by i desc, n desc, root) r from cp) where r = 1",
)

# --- points: the nearest, however far -----------------------------------------------------------------------------------------------------


def _ported(s, d):
    from .more_queries import _ported

    return _ported(s, d)


register(
    "solution_points_ported",
    lambda s, d: G.nearest(*_ported(s, d), 1, 0.3).select("idx", "near", r6("d").alias("d")),
    f"with {V.LONG}, pts as (select tf set_id, (e // 3)::int idx, max(x) filter (where e % 3 = 0) x, max(x) filter (where e % 3 = 1) y, max(x) filter (where e % 3 = 2) z from maps_long where e < 3 * (63 // 3) group by 1, 2),"
    " m as (select idx, avg(x) + 0.02 x, avg(y) - 0.02 y, avg(z) z from pts group by 1), t as (select idx, min_by(x, set_id) x, min_by(y, set_id) y, min_by(z, set_id) z from pts group by 1),"
    " j as (select m.idx, t.idx near, sqrt((m.x - t.x) ** 2 + (m.y - t.y) ** 2 + (m.z - t.z) ** 2) d from m, t)"
    " select idx, near, round(d, 6) d from (select *, row_number() over (partition by idx order by round(d, 9), near) n from j) where n = 1",
)
register(
    "export_selected_tracks",
    lambda s, d: V.maps_long(s, d).filter(~F.col("e").isin(0, 7, 63)).select("tf", "e", r6("x").alias("x")),
    f"with {V.LONG} select tf, e, round(x, 6) x from maps_long where e not in (0, 7, 63)",
)
register(
    "filter_not_auxiliaries",
    lambda s, d: V.samples(s, d).select("rec", "tf", "track", F.when(F.col("track").isin("signup", "error"), F.col("value")).otherwise(F.abs(F.col("value") - 50)).alias("value")),
    f"with {V.SAMPLES} select rec, tf, track, case when track in ('signup', 'error') then value else abs(value - 50) end as value from samples",
)
register(
    "names_sorted",
    lambda s, d: V.samples(s, d).select("rec", "track").distinct().groupBy("track").agg(F.array_sort(F.collect_list("rec")).alias("l")).select("track", F.posexplode("l").alias("place", "rec")),
    f"with {V.SAMPLES} select track, (row_number() over (partition by track order by rec) - 1)::int place, rec from (select distinct rec, track from samples)",
)
register(
    "ris_matmul_individual",
    lambda s, d: _individual(s, d),
    f"with {V.LONG}, mx as (select m, r, e, sin((m + 1) * (r + 1) * (e + 1)) w from (select unnest(range(3)) m), (select unnest(range(4)) r), (select unnest(range(64)) e))"
    " select tf, r::int r, round(sum(w * x), 6) v from maps_long l join mx on mx.m = l.label % 3 and mx.e = l.e group by 1, 2",
)


def _individual(s, d):
    """Every recording has a matrix of its own, by a matrix id: rows travel as arrays, an equi-join on the id."""
    e = F.sequence(F.lit(0), F.lit(63))
    row = lambda m, r: F.transform(e, lambda c: F.sin((m + 1) * (r + 1) * (c + 1)))
    matrices = s.range(3).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).select("m", "r", row(F.col("m"), F.col("r")).alias("w"))
    maps = V.maps(s, d).withColumn("m", F.pmod("label", F.lit(3)).cast("long"))
    return maps.join(matrices, "m").select("tf", "r", r6(F.aggregate(F.zip_with("w", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias("v"))
