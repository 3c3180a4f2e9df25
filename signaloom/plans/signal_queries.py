"""Queries over maps, tracks, markers and epochs, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M
from ..operators import epochs as EP
from ..operators import markers as MK
from ..operators import tracks as T
from . import views as V
from .catalog import register


def r6(c):
    return F.round(c, 6)


# --- maps -------------------------------------------------------------------------------------------------------------------------------------------------------------------
v = "v"
register("map_gfp", lambda s, d: V.maps(s, d).select("tf", r6(M.gfp(v)).alias("gfp")), f"with {V.LONG} select tf, round(stddev_pop(x), 6) gfp from maps_long group by 1")
register("map_rms", lambda s, d: V.maps(s, d).select("tf", r6(M.rms(v)).alias("rms")), f"with {V.LONG} select tf, round(sqrt(avg(x * x)), 6) rms from maps_long group by 1")
register("map_average", lambda s, d: V.maps(s, d).select("tf", r6(M.mean(v)).alias("mean")), f"with {V.LONG} select tf, round(avg(x), 6) mean from maps_long group by 1")
register(
    "map_average_reference",
    lambda s, d: V.maps(s, d).select("tf", F.posexplode(M.average_reference(v)).alias("e", "x")).select("tf", "e", r6("x").alias("x")),
    f"with {V.REF} select tf, e, round(x, 6) x from ref",
)
register(
    "map_other_reference",
    lambda s, d: V.maps(s, d).select("tf", F.posexplode(M.reference_to(v, [0, 5])).alias("e", "x")).select("tf", "e", r6("x").alias("x")),
    f"with {V.LONG} select tf, e, round(x - (max(case when e = 0 then x end) over (partition by tf) + max(case when e = 5 then x end) over (partition by tf)) / 2, 6) x from maps_long",
)
register(
    "map_gfp_normalize",
    lambda s, d: V.maps(s, d).select("tf", F.posexplode(M.scale(M.average_reference(v), 1 / M.gfp(v))).alias("e", "x")).select("tf", "e", r6("x").alias("x")),
    f"with {V.LONG} select tf, e, round((x - avg(x) over (partition by tf)) / stddev_pop(x) over (partition by tf), 6) x from maps_long",
)


def _successive(s, d):
    w = W.partitionBy("label").orderBy("tf")
    return V.maps(s, d).withColumn("u", F.lag("v").over(w)).filter("u is not null")


_PAIRS = (
    V.REF
    + ", nxt as (select vec_id tf, lag(vec_id) over (partition by label order by vec_id) p from embeddings)"
    + ", pair as (select n.tf, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) c from nxt n join ref a on a.tf = n.tf join ref b on b.tf = n.p and b.e = a.e group by 1)"
)
register("map_spatial_correlation", lambda s, d: _successive(s, d).select("tf", r6(M.correlation(F.col("u"), v)).alias("c")), f"with {_PAIRS} select tf, round(c, 6) c from pair")
register("map_dissimilarity", lambda s, d: _successive(s, d).select("tf", r6(M.dissimilarity(F.col("u"), v)).alias("dis")), f"with {_PAIRS} select tf, round(sqrt(greatest(0, 2 - 2 * c)), 6) dis from pair")
register("map_explained_variance", lambda s, d: _successive(s, d).select("tf", r6(M.explained_variance(F.col("u"), v)).alias("ev")), f"with {_PAIRS} select tf, round(c * c, 6) ev from pair")
register(
    "map_positive_correlation",
    lambda s, d: _successive(s, d).select("tf", r6(M.correlation(F.col("u"), v, positive=True)).alias("c")),
    f"with {V.LONG}, nxt as (select vec_id tf, lag(vec_id) over (partition by label order by vec_id) p from embeddings) select n.tf, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) c from nxt n join maps_long a on a.tf = n.tf join maps_long b on b.tf = n.p and b.e = a.e group by 1",
)
register(
    "map_minmax_electrode",
    lambda s, d: V.maps(s, d).select("tf", M.argmax(v).cast("int").alias("e_max"), M.argmin(v).cast("int").alias("e_min"), r6(F.array_max("v")).alias("x_max"), r6(F.array_min("v")).alias("x_min")),
    f"with {V.LONG}, m as (select *, row_number() over (partition by tf order by x desc, e) hi, row_number() over (partition by tf order by x, e) lo from maps_long) select tf, max(case when hi = 1 then e end)::int e_max, max(case when lo = 1 then e end)::int e_min, round(max(x), 6) x_max, round(min(x), 6) x_min from m group by 1",
)
register(
    "map_find_max_tf",
    lambda s, d: V.maps(s, d).groupBy("label").agg(F.max(F.struct(F.round(M.gfp(v), 9).alias("g"), (-F.col("tf")).alias("tf"))).alias("b")).select("label", (-F.col("b.tf")).alias("tf"), r6("b.g").alias("gfp")),
    f"with {V.LONG}, g as (select label, tf, round(stddev_pop(x), 9) g from maps_long group by 1, 2) select label, tf, round(g, 6) gfp from (select *, row_number() over (partition by label order by g desc, tf) n from g) where n = 1",
)

# --- tracks -----------------------------------------------------------------------------------------------------------------------------------------------------------------
S = V.samples
Q = f"with {V.SAMPLES} "
KEEP = ["rec", "tf", "track", "value"]
register("tracks_select_list", lambda s, d: T.select_tracks(S(s, d), ["click", "view"]).select(*KEEP), Q + "select rec, tf, track, value from samples where track in ('click', 'view')")
register("tracks_invert_selection", lambda s, d: T.exclude_tracks(S(s, d), ["click", "view"]).select(*KEEP), Q + "select rec, tf, track, value from samples where track not in ('click', 'view')")
register(
    "tracks_index_list",
    lambda s, d: V.maps_long(s, d).filter(F.col("e").isin(T.parse_list("1, 2, 10-15"))).select("tf", "e", r6("x").alias("x")),
    f"with {V.LONG} select tf, e, round(x, 6) x from maps_long where e in (1, 2, 10, 11, 12, 13, 14, 15)",
)


def _roles(s):
    return s.createDataFrame([("error", "bad"), ("signup", "aux")], "track string, role string")


register("tracks_exclude_bad", lambda s, d: T.with_role(S(s, d), _roles(s), "bad", keep=False).select(*KEEP), Q + "select rec, tf, track, value from samples where track <> 'error'")
register("tracks_keep_auxiliary", lambda s, d: T.with_role(S(s, d), _roles(s), "aux").select(*KEEP), Q + "select rec, tf, track, value from samples where track = 'signup'")
register(
    "tracks_above_threshold",
    lambda s, d: T.above_threshold(S(s, d), 300.0).select(*KEEP),
    Q + "select rec, tf, track, value from samples where (rec, track) in (select (rec, track) from samples group by rec, track having max(abs(value)) >= 300)",
)
register("tracks_names", lambda s, d: S(s, d).groupBy("track").agg(F.count_distinct("rec").alias("recs"), F.count("*").alias("n")), Q + "select track, count(distinct rec) recs, count(*) n from samples group by 1")
register("tracks_interval", lambda s, d: T.interval(S(s, d), 5, 20).select(*KEEP), Q + "select rec, tf, track, value from samples where tf between 5 and 20")
register("tracks_downsample", lambda s, d: T.downsample(S(s, d), 4).select(*KEEP), Q + "select rec, tf // 4 tf, track, value from samples where tf % 4 = 0")
register("tracks_time_average", lambda s, d: T.time_average(S(s, d)).select("rec", "track", r6("value").alias("value")), Q + "select rec, track, round(avg(value), 6) as value from samples group by 1, 2")
register("tracks_null_track", lambda s, d: T.null_track(S(s, d).select(*KEEP), "null"), Q + "select rec, tf, track, value from samples union all select rec, tf, 'null', 0.0 from samples")
register(
    "tracks_baseline",
    lambda s, d: T.baseline(S(s, d).select(*KEEP), 0, 15).withColumn("value", r6("value")),
    Q + "select rec, tf, track, round(value - coalesce(avg(case when tf between 0 and 15 then value end) over (partition by rec, track), 0), 6) as value from samples",
)
register("tracks_rescale", lambda s, d: T.rescale(S(s, d).select(*KEEP), 2.5).withColumn("value", r6("value")), Q + "select rec, tf, track, round(value * 2.5, 6) as value from samples")
register(
    "tracks_triggers_keep",
    lambda s, d: T.around(S(s, d).select(*KEEP), V.markers(s, d).filter("name = 'signup'"), 1, 2),
    f"with {V.MARKERS} select rec, tf, track, value from samples s where exists (select 1 from markers m where m.rec = s.rec and m.name = 'signup' and s.tf between m.tf - 1 and m.tf + 2)",
)
register(
    "tracks_triggers_exclude",
    lambda s, d: T.around(S(s, d).select(*KEEP), V.markers(s, d).filter("name = 'signup'"), 1, 2, keep=False),
    f"with {V.MARKERS} select rec, tf, track, value from samples s where not exists (select 1 from markers m where m.rec = s.rec and m.name = 'signup' and s.tf between m.tf - 1 and m.tf + 2)",
)
register(
    "tracks_regex", lambda s, d: MK.matching(S(s, d), "^(click|view)$|err", "track").groupBy("track").agg(F.count("*").alias("n")), Q + "select track, count(*) n from samples where regexp_matches(track, '^(click|view)$|err') group by 1"
)
register(
    "tracks_montage",
    lambda s, d: T.montage(V.maps_long(s, d).select("tf", F.col("e").alias("track"), F.col("x").alias("value")), 3, 7, ["tf"]).select("tf", r6("value").alias("value")),
    f"with {V.LONG} select a.tf, round(a.x - b.x, 6) as value from maps_long a join maps_long b on a.tf = b.tf where a.e = 3 and b.e = 7",
)
register(
    "tracks_concatenate",
    lambda s, d: T.concatenate([T.interval(S(s, d).select(*KEEP), 0, 9), T.interval(S(s, d).select(*KEEP), 3, 5)]),
    Q + "select rec, tf, track, value from samples where tf <= 9 union all select rec, s.tf + n, track, value from samples s join (select rec, max(tf) + 1 n from samples where tf <= 9 group by 1) using (rec) where s.tf between 3 and 5",
)
register(
    "tracks_superimpose",
    lambda s, d: S(s, d).filter("track = 'click'").select("rec", "tf", F.lit("a").alias("src"), "value").unionByName(S(s, d).filter("track = 'view'").select("rec", "tf", F.lit("b").alias("src"), "value")),
    Q + "select rec, tf, case track when 'click' then 'a' else 'b' end src, value from samples where track in ('click', 'view')",
)
register(
    "tracks_time_origin",
    lambda s, d: S(s, d).groupBy("rec").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).select("rec", (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))).alias("micros")),
    Q + "select rec, date_diff('microsecond', min(ts), max(ts)) micros from samples group by 1",
)
register(
    "calc_expression",
    lambda s, d: T.calculate({"g1": S(s, d).select("rec", "tf", "value"), "g2": S(s, d).select("rec", (F.col("tf") + 1).alias("tf"), "value")}, "(g1 - g2) / (abs(g1) + abs(g2) + 1)").withColumn("value", r6("value")),
    Q + "select a.rec, a.tf, round((a.value - b.value) / (abs(a.value) + abs(b.value) + 1), 6) as value from samples a join samples b on a.rec = b.rec and a.tf = b.tf + 1",
)
register(
    "corr_files",
    lambda s, d: S(s, d).select("rec", "tf", "value").join(S(s, d).select("rec", (F.col("tf") + 1).alias("tf"), F.col("value").alias("w")), ["rec", "tf"]).groupBy("rec").agg(r6(F.corr("value", "w")).alias("c")),
    Q + "select a.rec, round(corr(a.value, b.value), 6) c from samples a join samples b on a.rec = b.rec and a.tf = b.tf + 1 group by 1",
)
_STAT = {
    "tracks_flat": (lambda: F.coalesce(F.stddev_samp("value"), F.lit(0.0)), "coalesce(stddev_samp(value), 0)"),
    "tracks_outlier": (lambda: F.max(F.abs("value")), "max(abs(value))"),
}
for _name, (_col, _sql) in _STAT.items():
    register(
        _name,
        lambda s, d, c=_col: T.robust_outliers(S(s, d), c(), 2.5).select("rec", "track", r6("s").alias("s"), r6("z").alias("z"), "bad"),
        Q + f", p as (select rec, track, {_sql} s from samples group by 1, 2), m as (select *, median(s) over (partition by track) md from p), z as (select *, (s - md) / nullif(1.4826 * median(abs(s - md)) over (partition by track), 0) z from m) select rec, track, round(s, 6) s, round(z, 6) z, abs(z) > 2.5 bad from z",
    )
register(
    "tracks_jerky",
    lambda s, d: T.robust_outliers(S(s, d).withColumn("value", F.abs(F.col("value") - F.lag("value").over(W.partitionBy("rec", "track").orderBy("tf")))).filter("value is not null"), F.avg("value"), 2.5).select("rec", "track", r6("s").alias("s"), r6("z").alias("z"), "bad"),
    Q + ", p as (select rec, track, avg(j) s from (select rec, track, abs(value - lag(value) over (partition by rec, track order by tf)) j from samples) where j is not null group by 1, 2), m as (select *, median(s) over (partition by track) md from p), z as (select *, (s - md) / nullif(1.4826 * median(abs(s - md)) over (partition by track), 0) z from m) select rec, track, round(s, 6) s, round(z, 6) z, abs(z) > 2.5 bad from z",
)

# --- filters that need no recursion -----------------------------------------------------------------------------------------------------------------------------------------
register("filter_dc", lambda s, d: T.remove_dc(S(s, d).select(*KEEP)).withColumn("value", r6("value")), Q + "select rec, tf, track, round(value - avg(value) over (partition by rec, track), 6) as value from samples")
register(
    "filter_ranking",
    lambda s, d: T.rank_filter(V.maps_long(s, d).select("tf", "e", F.col("x").alias("value")), ["tf"]).withColumn("value", r6("value")),
    f"with {V.LONG} select tf, e, round(percent_rank() over (partition by tf order by x), 6) as value from maps_long",
)
register("filter_abs", lambda s, d: T.rectify(V.maps_long(s, d).select("tf", "e", F.col("x").alias("value"))).withColumn("value", r6("value")), f"with {V.LONG} select tf, e, round(abs(x), 6) as value from maps_long")
register("filter_power", lambda s, d: T.rectify(V.maps_long(s, d).select("tf", "e", F.col("x").alias("value")), True).withColumn("value", F.round("value", 8)), f"with {V.LONG} select tf, e, round(x * x, 8) as value from maps_long")
register("filter_envelope", lambda s, d: T.envelope(S(s, d).select(*KEEP), 3), Q + "select rec, tf, track, max(abs(value)) over (partition by rec, track order by tf rows between 3 preceding and 3 following) as value from samples")
register("filter_threshold_both", lambda s, d: S(s, d).select("rec", "tf", T.threshold("value", 100.0, 20.0).alias("outside"), T.threshold("value", 20.0, 100.0).alias("inside")), Q + "select rec, tf, case when value between 20 and 100 then 0.0 else value end outside, case when value between 20 and 100 then value else 0.0 end inside from samples")
register("filter_zscore", lambda s, d: T.standardise(S(s, d).select(*KEEP)).withColumn("value", r6("value")), Q + "select rec, tf, track, round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 6) as value from samples window w as (partition by rec, track)")

# --- histograms and statistics ----------------------------------------------------------------------------------------------------------------------------------------------
_HIST = "select {by} least(19, greatest(0, floor(value / 25)::int)) bin, count(*) n from samples group by all"


def _histo(by):
    names = "".join(f"{b}, " for b in by)
    part = f"partition by {', '.join(by)}" if by else ""
    sql = Q + f", h as ({_HIST.format(by=names)}) select {names} bin, n, round(ln(1 + n), 6) log_n, round(avg(n) over ({part} order by bin rows between 1 preceding and 1 following), 6) smooth, round(sum(n) over ({part} order by bin) / sum(n) over ({part}), 6) cdf from h"
    return (lambda s, d: T.histogram(S(s, d), 0.0, 500.0, 20, by).select(*by, "bin", "n", r6("log_n").alias("log_n"), r6("smooth").alias("smooth"), r6("cdf").alias("cdf"))), sql


register("histo_time", *_histo(("rec", "track")))
register("histo_tracks", *_histo(("track",)))
register("histo_block", *_histo(()))
register(
    "stats_basic",
    lambda s, d: S(s, d).groupBy("track").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), r6(F.percentile("value", F.lit(0.5))).alias("med"), r6(F.percentile("value", F.lit(0.9))).alias("p90")),
    Q + "select track, min(value) lo, max(value) hi, round(avg(value), 6) mean, round(stddev_samp(value), 6) sd, round(median(value), 6) med, round(quantile_cont(value, 0.9), 6) p90 from samples group by 1",
)
register("histo_equalize", lambda s, d: S(s, d).select("rec", "tf", r6(F.cume_dist().over(W.partitionBy("rec").orderBy("value"))).alias("value")), Q + "select rec, tf, round(cume_dist() over (partition by rec order by value), 6) as value from samples")

# --- markers ----------------------------------------------------------------------------------------------------------------------------------------------------------------
MS = f"with {V.MARKERS} "
K = V.markers
register("marker_kind_filter", lambda s, d: K(s, d).filter("name = 'error'"), MS + "select * from markers where name = 'error'")
register("marker_regexp_replace", lambda s, d: MK.rename(K(s, d), "^(s)ign(up)$", "$1-$2"), MS + r"select rec, tf, regexp_replace(name, '^(s)ign(up)$', '\1-\2') as name from markers")
register(
    "marker_bitwise_split",
    lambda s, d: MK.split_bits(S(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("code")), "code", 8),
    Q + ", c as (select event_id, cast(json_extract_string(props, '$.k') as bigint) code from samples) select event_id, code, b::int bit from c, (select unnest(range(8)) b) where (code & (1::bigint << b)) <> 0",
)
register("marker_naming", lambda s, d: MK.numbered(K(s, d), "M"), MS + "select rec, tf, 'M_' || name || '_' || row_number() over (partition by rec, name order by tf) as name from markers")
register("marker_delete_range", lambda s, d: MK.delete_between(K(s, d), 10, 40), MS + "select * from markers where tf not between 10 and 40")
register("marker_duplicate", lambda s, d: K(s, d).withColumn("kind", F.lit("trigger")).unionByName(K(s, d).withColumn("kind", F.lit("marker"))), MS + "select *, 'trigger' kind from markers union all select *, 'marker' from markers")
register(
    "marker_merge_overlap",
    lambda s, d: MK.merge_overlapping(K(s, d).select("rec", F.floor(F.col("tf") / 4).alias("from_tf"), (F.floor(F.col("tf") / 4) + 3).alias("to_tf"), "name")),
    MS + "select rec, tf // 4 from_tf, tf // 4 + 3 to_tf, array_to_string(list_sort(list(distinct name)), '+') as name from markers group by 1, 2, 3",
)
_RUNS = "r as (select *, sum(n) over (partition by rec order by tf) run from (select rec, tf, {v} val, case when {v} is not distinct from lag({v}) over (partition by rec order by tf) and tf > 0 then 0 else 1 end n from samples))"
register(
    "marker_merge_contiguous",
    lambda s, d: MK.runs(S(s, d).select("rec", "tf", F.col("track").alias("name")), "name").drop("run"),
    Q + f", {_RUNS.format(v='track')} select rec, any_value(val) as name, min(tf) from_tf, max(tf) to_tf, count(*) n from r group by rec, run",
)
register(
    "scan_merge_tolerance",
    lambda s, d: MK.merge_close(K(s, d), 3),
    MS + ", g as (select *, sum(n) over (partition by rec order by tf) run from (select *, case when tf - lag(tf) over (partition by rec order by tf) <= 3 then 0 else 1 end n from markers)) select rec, min(tf) from_tf, max(tf) to_tf, count(*) n from g group by rec, run",
)
register("marker_next_previous", lambda s, d: MK.neighbours(K(s, d)), MS + "select *, lag(tf) over (partition by rec order by tf) previous_tf, lead(tf) over (partition by rec order by tf) next_tf from markers")
register(
    "scan_extrema",
    lambda s, d: MK.extrema(S(s, d).select("rec", "tf", "value")),
    Q + "select rec, tf, value, kind from (select rec, tf, value, case when value > b and value > a then 'max' when value < b and value < a then 'min' end kind from (select *, lag(value) over w b, lead(value) over w a from samples window w as (partition by rec order by tf))) where kind is not null",
)
register(
    "scan_threshold_first",
    lambda s, d: MK.crossings(S(s, d).select("rec", "tf", "value"), 150.0).select("rec", "tf", r6("slope").alias("slope")),
    Q + "select rec, tf, round(value - b, 6) slope from (select *, lag(value) over (partition by rec order by tf) b from samples) where value >= 150 and b < 150",
)
register(
    "scan_threshold_slope",
    lambda s, d: MK.steepest(S(s, d).select("rec", "tf", "value"), 150.0).select("rec", "tf"),
    Q + ", u as (select *, value >= 150 up, abs(value - lag(value) over (partition by rec order by tf)) slope from samples), r as (select *, sum(st) over (partition by rec order by tf) run from (select *, case when up and not coalesce(lag(up) over (partition by rec order by tf), false) then 1 else 0 end st from u)) select rec, tf from (select *, row_number() over (partition by rec, run order by coalesce(slope, -1) desc, tf) n from r where up) where n = 1",
)
register(
    "scan_duration_gap",
    lambda s, d: MK.lasting(S(s, d).select("rec", "tf", "value"), F.col("value") >= 60, 1, 3, 2),
    Q + f", {_RUNS.format(v='(value >= 60)')}, h as (select rec, run, any_value(val) onn, min(tf) from_tf, max(tf) to_tf, count(*) n from r group by rec, run), k as (select *, lead(n) over (partition by rec order by from_tf) rest from h) select rec, from_tf, to_tf, n from k where onn and n between 1 and 3 and (rest is null or rest >= 2)",
)


def _stability(s, d):
    w = W.partitionBy("label").orderBy("tf")
    seq = V.maps(s, d).withColumn("n", F.row_number().over(w)).withColumn("c", M.correlation(F.lag("v").over(w), v))
    return MK.runs(seq.select("label", "n", (F.abs(F.round("c", 9)) >= 0.1).alias("on")), "on", ("label",), "n").filter("on").select("label", "from_tf", "to_tf", "n")


register(
    "scan_stability",
    _stability,
    f"with {_PAIRS}, q as (select e.label, row_number() over (partition by e.label order by e.vec_id) n, abs(round(p.c, 9)) >= 0.1 onn from embeddings e left join pair p on p.tf = e.vec_id), g as (select *, sum(st) over (partition by label order by n) run from (select *, case when n > 1 and onn is not distinct from lag(onn) over (partition by label order by n) then 0 else 1 end st from q)) select label, min(n) from_tf, max(n) to_tf, count(*) n from g where onn group by label, run",
)

# --- epochs -----------------------------------------------------------------------------------------------------------------------------------------------------------------
_CUT = V.MARKERS + ", ep as (select s.rec, m.tf origin, m.name, s.tf - m.tf rel, s.track, s.value from samples s join markers m on s.rec = m.rec and s.tf between m.tf - 5 and m.tf + 10)"


def _epochs(s, d):
    return EP.cut(S(s, d), K(s, d), 5, 10)


register("epoch_average", lambda s, d: EP.average(_epochs(s, d)).select("rel", "n", r6("mean").alias("mean")), f"with {_CUT} select rel, count(*) n, round(avg(value), 6) mean from ep group by 1")
register("epoch_sum", lambda s, d: EP.average(_epochs(s, d), ("rel", "track")).select("rel", "track", r6("total").alias("total")), f"with {_CUT} select rel, track, round(sum(value), 6) total from ep group by 1, 2")
register("epoch_sd_se", lambda s, d: EP.average(_epochs(s, d)).select("rel", r6("sd").alias("sd"), r6("se").alias("se")), f"with {_CUT} select rel, round(stddev_samp(value), 6) sd, round(stddev_samp(value) / sqrt(count(*)), 6) se from ep group by 1")
register(
    "epoch_split_triggers",
    lambda s, d: EP.average_split_and_merged(_epochs(s, d)).select("name", "rel", "n", r6("mean").alias("mean")),
    f"with {_CUT} select name, rel, count(*) n, round(avg(value), 6) mean from ep group by grouping sets ((name, rel), (rel))",
)
register(
    "epoch_rejection",
    lambda s, d: EP.average(EP.accepted(_epochs(s, d), 250.0, ["signup"]), ("name", "rel")).select("name", "rel", "n", r6("mean").alias("mean")),
    f"with {_CUT}, ok as (select rec, origin from ep where track <> 'signup' group by 1, 2 having max(abs(value)) <= 250) select name, rel, count(*) n, round(avg(value), 6) mean from ep join ok using (rec, origin) group by 1, 2",
)
register("epoch_accepted", lambda s, d: EP.accepted(_epochs(s, d), 250.0).select("rec", "origin", "rel", "value"), f"with {_CUT}, ok as (select rec, origin from ep group by 1, 2 having max(abs(value)) <= 250) select rec, origin, rel, value from ep join ok using (rec, origin)")
register(
    "epoch_reaction_time",
    lambda s, d: EP.reaction(K(s, d), S(s, d).filter("track = 'purchase'"), 20),
    f"with {V.MARKERS} select m.rec, m.tf, m.name, min(p.tf) event_tf, min(p.tf) - m.tf latency from markers m join samples p on m.rec = p.rec and p.track = 'purchase' and p.tf between m.tf and m.tf + 20 group by 1, 2, 3",
)
register("epoch_tva_semi", lambda s, d: EP.validated(K(s, d), S(s, d).filter("value >= 50").select("rec", "tf")), MS + "select m.* from markers m where (rec, tf) in (select (rec, tf) from samples where value >= 50)")
register(
    "epoch_exclude_bad",
    lambda s, d: T.around(K(s, d), S(s, d).filter("value > 300").select("rec", "tf"), 2, 2, keep=False),
    MS + "select m.* from markers m where not exists (select 1 from samples b where b.rec = m.rec and b.value > 300 and m.tf between b.tf - 2 and b.tf + 2)",
)
register(
    "bad_epochs",
    lambda s, d: MK.merge_close(S(s, d).filter("value > 300 or track = 'error'").select("rec", "tf"), 2),
    Q + ", b as (select rec, tf from samples where value > 300 or track = 'error'), g as (select *, sum(n) over (partition by rec order by tf) run from (select *, case when tf - lag(tf) over (partition by rec order by tf) <= 2 then 0 else 1 end n from b)) select rec, min(tf) from_tf, max(tf) to_tf, count(*) n from g group by rec, run",
)
register("batch_average", lambda s, d: S(s, d).groupBy("tf", "track").agg(F.round(F.avg("value"), 9).alias("value"), F.count("*").alias("n")), Q + "select tf, track, round(avg(value), 9) as value, count(*) n from samples group by 1, 2")
register(
    "grand_average_rollup",
    lambda s, d: EP.grand_average(S(s, d), "track", "rec").select("track", "rec", r6("mean").alias("mean"), "n"),
    Q + ", p as (select track, rec, avg(value) m from samples group by 1, 2) select track, rec, round(avg(m), 6) mean, count(*) n from p group by rollup (track, rec)",
)
register("roi_average", lambda s, d: V.maps_long(s, d).join(_rois(s), "e").groupBy("tf", "roi").agg(r6(F.avg("x")).alias("x")), f"with {V.LONG} select tf, case when e < 16 then 'front' else 'back' end roi, round(avg(x), 6) x from maps_long where e < 16 or e >= 40 group by 1, 2")


def _rois(s):
    """Region membership is a small table of electrode numbers; the planner broadcasts it if it is under its own threshold."""
    return s.range(64).select(F.col("id").cast("int").alias("e"), F.when(F.col("id") < 16, "front").when(F.col("id") >= 40, "back").alias("roi")).filter("roi is not null")
