"""Operators on tiny frames with known answers, and invariants."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signaloom.functions import maps as M
from signaloom.operators import epochs as EP
from signaloom.operators import filters as FL
from signaloom.operators import frequency as FR
from signaloom.operators import geometry as G
from signaloom.operators import markers as MK
from signaloom.operators import microstates as MS
from signaloom.operators import source_space as SS
from signaloom.operators import statistics as ST
from signaloom.operators import tracks as T
from signaloom.operators import volumes as VO


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} array<double>" for c in columns)).select(expr).first()[0]


def test_map_measures(spark):
    a, b, c = [1.0, -1.0, 1.0, -1.0], [-1.0, 1.0, -1.0, 1.0], [1.0, 1.0, -1.0, -1.0]
    assert all(one(spark, M.gfp(F.col("v")), v=x) == 1 for x in (a, b, c))
    for u, v, dis, corr in ((a, a, 0, 1), (a, b, 2, -1), (a, c, math.sqrt(2), 0)):
        assert one(spark, M.dissimilarity(F.col("u"), F.col("v")), u=u, v=v) == pytest.approx(dis)
        assert one(spark, M.correlation(F.col("u"), F.col("v")), u=u, v=v) == pytest.approx(corr)
    assert one(spark, M.gfp(F.col("v"), positive=True), v=[3.0, 4.0]) == pytest.approx(math.sqrt(12.5))
    assert one(spark, M.correlation(F.col("u"), F.col("v")), u=[1.0, 1.0], v=[1.0, 2.0]) is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=3, max_size=8))
def test_correlation_and_dissimilarity_agree(spark, pairs):
    u, v = ([float(p[k]) for p in pairs] for k in (0, 1))
    row = spark.createDataFrame([(u, v)], "u array<double>, v array<double>").select(M.correlation(F.col("u"), F.col("v")), M.dissimilarity(F.col("u"), F.col("v"))).first()
    if row[0] is not None:
        assert -1 - 1e-6 <= row[0] <= 1 + 1e-6 and 0 <= row[1] <= 2 + 1e-6 and row[0] == pytest.approx(1 - row[1] ** 2 / 2, abs=1e-6)


def frame(spark, rows):
    return spark.createDataFrame([(1, i, "a", float(v)) for i, v in enumerate(rows)], "rec int, tf long, track string, value double")


def test_lists_regex_and_threshold(spark):
    assert T.parse_list("1, 2, 10-15") == [1, 2, 10, 11, 12, 13, 14, 15]
    names = "EyesOpen EyesClosed Trigger1 Trigger2 Trigger10 Trigger20 GfpAbove80 GfpAbove90 GfpAbove100".split()
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for pattern, hits in (("Eyes", 2), ("Trig", 4), ("1", 3), ("0", 5), ("1.", 2), ("T......1", 2), ("Eyes(Open|Closed)", 2), ("Above(90|100)", 2)):
        assert MK.matching(df, pattern).count() == hits
    assert [r[0] for r in frame(spark, [1, 5, 9]).select(T.threshold("value", 4, 6)).collect()] == [0, 5, 0]
    assert [r[0] for r in frame(spark, [1, 5, 9]).select(T.threshold("value", 6, 4)).collect()] == [1, 0, 9]


def test_runs_and_labels(spark):
    seg = [1, 1, 1, 2, 2, 3, 3, 3, 3]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(seg)], "rec int, tf long, seg int")
    assert [(r["seg"], r["from_tf"], r["n"]) for r in MS.segments(df).orderBy("from_tf").collect()] == [(1, 0, 3), (2, 3, 2), (3, 5, 4)]
    assert [r["seg"] for r in MS.reject_small(df, 2).orderBy("tf").collect()] == [1, 1, 1, 1, 3, 3, 3, 3, 3]
    one = MK.merge_close(spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "rec int, tf long"), 2).orderBy("from_tf").collect()
    assert [(r["from_tf"], r["to_tf"], r["n"]) for r in one] == [(1, 3, 2), (9, 9, 1)]


def test_resampled_epochs_reach_all_frames(spark):
    """The query on about 200 frames a label: starts reach the whole length, epochs are whole, and the share covered is what was asked for."""
    from signaloom.plans import catalog

    found = catalog.queries()["seg_resampled_epochs"](spark, "/root/testdata/sf0.1").collect()
    tf = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("label", "vec_id").orderBy("vec_id").collect():
        tf[r.label].append(r.vec_id)
    place, epochs = {(k, v): n for k, vs in tf.items() for n, v in enumerate(vs)}, defaultdict(list)
    for r in found:
        epochs[r.label, r.n].append(place[r.label, r.tf])
    assert all(sorted(e) == list(range(min(e), min(e) + 8)) for e in epochs.values())
    for label, frames in tf.items():
        reached = {x for (k, _), e in epochs.items() if k == label for x in e}
        assert max(reached) > 0.9 * len(frames)
    assert len({(r.label, r.tf) for r in found}) > 0.9 * len(place)
    few = spark.createDataFrame([(1, t) for t in range(5)], "label int, tf long")
    assert {r.tf for r in EP.resampled(few, "label", 8, 0.95).collect()} == set(range(5))


def test_epochs_reaction_and_rejection(spark):
    s = frame(spark, [0, 1, 2, 3, 4, 500, 6, 7])
    origins = spark.createDataFrame([(1, 2, "t"), (1, 6, "t")], "rec int, tf long, name string")
    cut = EP.cut(s, origins, 1, 1)
    assert sorted((r["origin"], r["rel"], r["value"]) for r in cut.collect()) == [(2, -1, 1), (2, 0, 2), (2, 1, 3), (6, -1, 500), (6, 0, 6), (6, 1, 7)]
    assert {r["origin"] for r in EP.accepted(cut, 100).collect()} == {2}
    events = spark.createDataFrame([(1, 4)], "rec int, tf long")
    assert [(r["tf"], r["event_tf"]) for r in EP.reaction(origins, events, 10).collect()] == [(2, 4)]


def test_spectra(spark):
    n = 32
    x = [math.sin(2 * math.pi * 4 * i / n) for i in range(n)]
    win = FR.complete(FR.windows(frame(spark, x), n, n), n)
    power = {r["f"]: r["power"] for r in FR.dft(win, n, range(17)).collect()}
    assert max(power, key=power.get) == 4 and power[4] == pytest.approx((n / 2) ** 2)
    fast = {r["f"]: r["power"] for r in FR.fft(win, n).collect()}
    assert all(power[f] == pytest.approx(fast[f], abs=1e-9) for f in power)
    parseval = FR.dft(win, n, range(n), "parseval").agg(F.sum("power")).first()[0]
    assert parseval == pytest.approx(sum(v * v for v in x))
    z = {(r["tf"], r["f"]): math.hypot(r["re"], r["im"]) for r in FR.s_transform(frame(spark, x), [1, 4, 8]).collect()}
    assert z[16, 4] > 3 * z[16, 1] and z[16, 4] > 3 * z[16, 8]
    assert FR.log_grid(2, 1, 10) == pytest.approx([1, math.sqrt(10), 10])


def test_butterworth():
    for kind in ("low", "high"):
        sections = FL.butterworth(kind, 4, 5.0, 100.0)
        gain = lambda f: abs(np.prod([(s[0] + s[1] * w + s[2] * w * w) / (1 + s[3] * w + s[4] * w * w) for w in [np.exp(-2j * np.pi * f / 100)] for s in sections]))
        assert gain(5) == pytest.approx(1 / math.sqrt(2), rel=1e-6)
        assert gain(0.001 if kind == "low" else 49.9) == pytest.approx(1, abs=1e-3) and gain(40 if kind == "low" else 0.1) < 1e-2
    y, _ = FL.run_sections(FL.notches(10, 100), np.sin(2 * np.pi * 10 * np.arange(4000) / 100))
    assert np.abs(y[-200:]).max() < 0.05


def test_clustering(spark):
    rng = np.random.default_rng(0)
    base = np.linalg.qr(rng.normal(size=(16, 3)))[0].T
    lab = rng.integers(0, 3, 90)
    x = base[lab] * rng.choice([-1, 1], 90)[:, None] * rng.uniform(1, 2, 90)[:, None] + rng.normal(0, 0.05, (90, 16))
    for labels in (max((MS.kmeans_trial(x, 3, s) for s in range(5)), key=lambda t: t[2])[0], MS.taahc(x, 3, 3)[3]):
        assert len(set(zip(lab, labels))) == 3
    assert MS.kmeans_trial(x, 90, 0)[2] == pytest.approx(1, abs=1e-6)
    df = spark.createDataFrame([(0, i, [float(v) for v in r]) for i, r in enumerate(x)], "label int, tf long, v array<double>")
    best = MS.criteria(df, MS.cluster(df, range(1, 6), 4)).toPandas().set_index("k")
    assert best.silhouettes.idxmax() == 3 and best.meta_criterion.idxmax() == 3


def test_statistics(spark):
    p = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-12.706204736, 1.0), (None, 3.0), (1.959963985, 1e7)], "t double, df double").select(ST.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in p[:3]] == pytest.approx([0.07338803, 1, 0.05], abs=1e-6) and p[3].p is None and p[4].p == pytest.approx(0.05, abs=1e-5)
    q = ST.false_discovery(spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5), (5, 0.02)], "i int, p double")).orderBy("i").collect()
    assert [r["q"] for r in q] == pytest.approx([0.0333333, 0.0333333, 0.0375, 0.5, 0.0333333], abs=1e-6)
    rows = [(s, float(s % 5), float(s % 5) + 5) for s in range(12)]
    r = ST.randomised(spark.createDataFrame(rows, "s int, a double, b double"), [], "a", "b", "s", 200).first()
    assert r.m == pytest.approx(5) and r.p < 0.03


def test_volumes(spark):
    shape = [(x, y) for x in range(8) for y in range(8)]
    img = {(x, y): float(1 <= x <= 3 and 1 <= y <= 3 or (x, y) == (6, 6)) for x, y in shape}
    df = spark.createDataFrame([(x, y, 0, v) for (x, y), v in img.items()], "x int, y int, z int, v double")
    on = lambda d: {(r.x, r.y) for r in d.collect() if r.v > 0}
    assert on(VO.erode(df)) == {(2, 2)}
    assert on(VO.opened(df)) == {(2, 1), (2, 2), (2, 3), (1, 2), (3, 2)}
    found = VO.regions(df)
    assert found.select("region").distinct().count() == 2 and VO.biggest(found).count() == 9
    assert on(VO.combine(df, VO.flip(df, "x", 8), "difference")) == {(x, y) for x, y in shape if (img[x, y] > 0) != (img[7 - x, y] > 0)}
    assert VO.coregister(df, df.withColumn("x", F.col("x") + 1)) == (-1, 0)
    assert VO.tissue_levels([(0.0, 50), (0.1, 50), (1.0, 30), (2.0, 20)]) == pytest.approx([0.525, 1.5])


def test_geometry():
    rng = np.random.default_rng(0)
    p, angle = rng.normal(size=(20, 3)), 0.7
    r = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    k, rot, shift = G.similarity(p, 2 * p @ r.T + [1, 2, 3])
    assert k == pytest.approx(2) and np.allclose(rot, r) and np.allclose(shift, [1, 2, 3])
    e = p / np.linalg.norm(p, axis=1, keepdims=True)
    w = G.spline_weights(e, e, ridge=0)
    assert np.allclose(w @ e[:, 0], e[:, 0], atol=1e-3) and np.allclose(w.sum(1), 1)
    points = e[:5] * 0.5
    lead = SS.lead_field(e, points)
    for model in ("mn", "wmn", "sdale", "sloreta", "loreta", "laura", "eloreta"):
        m = SS.inverse_matrices(lead, model, points=points)
        assert len(m) == 13 and all(np.isfinite(x).all() for x in m)
    assert np.allclose(lead @ SS.inverse_matrices(lead, "mn")[0] @ lead, lead, atol=1e-6)


def test_ica_separates():
    t = np.arange(2000)
    s = np.stack([np.sign(np.sin(t / 17)), (t % 53) / 53 - 0.5, np.random.default_rng(0).laplace(size=2000)], 1)
    x = s @ np.random.default_rng(1).normal(size=(3, 5))
    u = (x - x.mean(0)) @ SS.independent(x, 3).T
    assert (np.abs(np.corrcoef(u.T, s.T)[:3, 3:]).max(1) > 0.95).all()


def test_regions_of_any_coordinates_and_length(spark):
    """Far voxels keep regions of their own; a snake of 1,000 steps is one region."""
    from signaloom.operators import volumes as VO

    far = spark.createDataFrame([(1000, 0, 0, 1.0), (0, 1, 0, 1.0), (2**40, 7, -3, 1.0)], "x long, y long, z long, v double")
    assert len({r.region for r in VO.regions(far).collect()}) == 3
    snake, x, y = [], 0, 0
    for k in range(1_000):
        snake.append((x, y, 0, 1.0))
        x, y = (x, y + 1) if k % 100 in (98, 99) else (x + (1 if k // 100 % 2 == 0 else -1), y)
    found = VO.regions(spark.createDataFrame([*snake, (0, -5, 0, 1.0), (500, 0, 0, 0.0)], "x int, y int, z int, v double")).collect()
    assert len(found) == len(set(snake)) + 1 and len({r.region for r in found}) == 2
    assert VO.regions(far.limit(0)).collect() == []


def test_nearest_reaches_as_far_as_needed(spark):
    from signaloom.operators import geometry as G

    rng = np.random.default_rng(0)
    p, t = rng.normal(0, 40, (30, 3)), rng.normal(0, 3, (12, 3))
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)] + [(99, None, 1.0, 1.0)], "idx int, x double, y double, z double")
    targets = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(t)], "idx int, x double, y double, z double")
    got = {(r.idx, r.near) for r in G.nearest(points, targets, 3, 0.5).collect()}
    assert got == {(i, int(j)) for i, x in enumerate(p) for j in np.argsort(np.linalg.norm(t - x, axis=1))[:3]}
    assert len(G.nearest(points, targets.limit(2), 3, 0.5).collect()) == 60 and G.nearest(points, targets.limit(0), 3, 0.5).collect() == []


def test_fitted_equals_label_of_correlations(spark):
    from signaloom.operators import microstates as MS

    rng = np.random.default_rng(1)
    maps = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(40)] + [(40, [1.0] * 8)], "tf long, v array<double>")
    templates = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(5)], "k int, t array<double>")
    a = {r.tf: (r.seg, r.corr and round(r.corr, 9)) for r in MS.fitted(maps, templates, 0.4).collect()}
    b = {r.tf: (r.seg, r.corr and round(r.corr, 9)) for r in MS.label(MS.correlations(maps, templates), least=0.4).collect()}
    assert {k: v for k, v in a.items() if k < 40} == {k: v for k, v in b.items() if k < 40} and a[40][0] is None


def test_downsampling_keeps_slower_recordings(spark):
    from signaloom.operators import sessions as SE

    samples = spark.createDataFrame([(r, k, float(k)) for r in (1, 2) for k in range(10)], "rec int, tf long, value double")
    recs = spark.createDataFrame([(1, 0, 100.0), (2, 1, 20.0)], "rec int, session int, hz double")
    got = sorted((r.rec, r.tf, r.value, r.hz) for r in SE.to_frequency(samples, recs, 50.0).collect())
    assert got == [(1, k, 2.0 * k, 50.0) for k in range(5)] + [(2, k, float(k), 20.0) for k in range(10)]


def test_best_level_needs_no_shuffle_of_maps(spark):
    from signaloom.operators import source_space as SS

    rng = np.random.default_rng(4)
    lead = rng.normal(size=(10, 6))
    levels = SS.inverse_matrices(lead, "mn")
    field = spark.createDataFrame([(a // 3, a % 3, e, float(lead[e, a])) for e in range(10) for a in range(6)], "sp int, axis int, e int, l double")
    inside, x = lead @ rng.normal(size=(6, 20)), rng.normal(size=(10, 20))
    maps = [*inside.T * 0.001, *x.T, *(inside + 0.1 * x).T, np.zeros(10), x[:7, 0]]
    df = spark.createDataFrame([(i, [float(v) for v in m]) for i, m in enumerate(maps)] + [(90, None), (91, [])], "tf long, v array<double>")
    best = SS.best_level(df, SS.as_table(spark, levels), field)
    expected = {}
    for i, m in enumerate(maps):
        v = [w[:, : len(m)] @ m for w in levels]
        rest = [((m - (lead @ r)[: len(m)]) ** 2).sum() for r in v]
        expected[i] = int(np.argmin([round(np.log(a + 1e-12) + np.log((r**2).sum() + 1e-12), 9) for a, r in zip(rest, v)]))
    assert {r.tf: r.reg for r in best.collect()} == expected and len(set(expected.values())) > 1
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_nearest_broadcasts_nothing_that_grows_with_the_points(spark, monkeypatch):
    from signaloom.operators import geometry as G

    plans, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    points = spark.range(400).selectExpr("cast(id as int) as idx", "cast(id as double) as x", "0D as y", "0D as z")
    targets = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(5)], "idx int, x double, y double, z double")
    assert G.nearest(points, targets, 2, 100.0).count() == 800
    assert any("LeftAnti" in p for p in plans) and not any("LeftAnti" in p and "Broadcast" in p for p in plans)
    monkeypatch.setattr(G, "FEW", 1)
    del plans[:]
    assert G.nearest(points, targets, 2, 400.0).count() == 800 and not any("Broadcast" in p for p in plans)


def test_criteria_do_not_depend_on_how_many_pairs_are_held(spark, monkeypatch):
    from signaloom.operators import microstates as MS

    rng = np.random.default_rng(2)
    u = MS._unit(np.vstack([rng.normal(size=(90, 6)), np.repeat(rng.normal(size=(1, 6)), 20, 0)]))
    labels = [rng.integers(0, k, len(u)) for k in (1, 2, 4)]
    i, j = np.triu_indices(len(u), 1)
    d = (1 - np.abs(np.clip(u @ u.T, -1, 1)))[i, j]
    monkeypatch.setattr(MS, "PAIRS", 300)
    found = MS._pair_criteria(u, labels)
    assert max(len(x) for x, _, _ in MS._pair_distances(u)) <= 300 and len(MS._ranges(u)) > 10
    assert np.isnan(found[0]).all()
    for lab, got in zip(labels[1:], found[1:]):
        inside = lab[i] == lab[j]
        less, more = (sum(int(f(d[~inside], x).sum()) for x in d[inside]) for f in (np.less, np.greater))
        pb = (d[~inside].mean() - d[inside].mean()) * np.sqrt(inside.mean() * (1 - inside.mean())) / d.std()
        assert got == pytest.approx(((more - less) / (more + less), pb, np.percentile(d[~inside], 5) / np.percentile(d[inside], 95)), rel=1e-6)
