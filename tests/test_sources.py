"""Readers and writers, there and back."""

import math

import pytest
from pyspark.sql import functions as F

from signaloom.sources import binary as B
from signaloom.sources import text as X


def recording(spark, frames=250, tracks=3):
    return spark.range(frames).select(F.col("id").alias("tf"), F.posexplode(F.array(*[F.sin(F.col("id") / (3.0 + k)) * 80 for k in range(tracks)])).alias("track", "value"))


def same(a, b, tolerance):
    x, y = ({(r.tf, r.track): r.value for r in d.collect()} for d in (a, b))
    assert set(x) <= set(y) and all(math.isclose(x[k], y[k], abs_tol=tolerance) for k in x)


@pytest.mark.parametrize(("bits", "tolerance"), [(16, 4e-3), (24, 2e-5)])
def test_edf(spark, tmp_path, bits, tolerance, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 700)
    path = str(tmp_path / "a.edf")
    B.write_edf(recording(spark), path, 100, ["A", "B", "C"], -100, 100, bits)
    assert B.edf_header(path)["labels"] == ["A", "B", "C"] and B.edf_header(path)["records"] == 3
    same(recording(spark), B.read_edf(spark, path), tolerance)


def test_brainvision(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 500)
    B.write_brainvision(recording(spark), str(tmp_path / "b"), 250.0, ["A", "B", "C"])
    same(recording(spark), B.read_brainvision(spark, str(tmp_path / "b.vhdr")), 1e-4)
    (tmp_path / "b.vmrk").write_text("[Marker Infos]\nMk1=Stimulus,S 1,11,1,0\nMk2=Response,R 2,21,5,0\n")
    rows = B.read_brainvision_markers(spark, str(tmp_path / "b.vmrk")).collect()
    assert [(r.from_tf, r.to_tf, r.name) for r in rows] == [(10, 10, "S 1"), (20, 24, "R 2")]


@pytest.mark.parametrize("name", ["v.nii", "v.nii.gz"])
def test_nifti(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(B, "RANGE", 100)
    df = spark.range(60).select((F.col("id") % 3).cast("int").alias("x"), (F.floor(F.col("id") / 3) % 4).cast("int").alias("y"), F.floor(F.col("id") / 12).cast("int").alias("z"), F.sqrt("id").alias("v")).filter("z <> 2")
    B.write_volume(df, str(tmp_path / name), (3, 4, 6))
    back = {(r.x, r.y, r.z): r.v for r in B.read_volume(spark, str(tmp_path / name)).collect()}
    assert len(back) == 72 and all(math.isclose(back[r.x, r.y, r.z], r.v, rel_tol=1e-6) for r in df.collect()) and back[0, 0, 2] == 0
    B.write_volume(df, str(tmp_path / "b.nii"), (3, 4, 6), kind="u1")
    assert {r.v for r in B.read_volume(spark, str(tmp_path / "b.nii")).collect()} <= set(map(float, range(9)))


def test_text(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "a.ep").write_text("1 2\n3 4\n")
    assert sorted((r.tf, r.track, r.value) for r in X.read_tracks(spark, p("a.ep")).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    (tmp_path / "a.eph").write_text("2 2 125.0\n1\t2\n3\t4\n")
    assert X.read_eph_headers(spark, p("a.eph")).first()[1:] == (2, 2, 125.0) and X.read_tracks(spark, p("a.eph"), header=True).count() == 4
    X.write_tracks(recording(spark, 5).withColumn("value", F.round("value", 3)), p("out.ep"))
    assert spark.read.text(p("out.ep")).count() == 5
    (tmp_path / "m.mrk").write_text('TL02\n10\t12\t"a b"\n20\t20\t"c"\n')
    m = X.read_markers(spark, p("m.mrk"))
    assert [tuple(r)[1:] for r in m.collect()] == [(10, 12, "a b"), (20, 20, "c")]
    X.write_markers(m, p("out.mrk"))
    assert X.read_markers(spark, p("out.mrk")).count() == 2
    pts = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "Fp1"), (1, 4.0, 5.0, 6.0, "Fp2")], "idx int, x double, y double, z double, name string")
    X.write_points(pts, p("e.xyz"))
    assert [tuple(r)[1:] for r in X.read_points(spark, p("e.xyz")).orderBy("idx").collect()] == [tuple(r) for r in pts.collect()]
    (tmp_path / "s.seg").write_text("5 2 0\n1 0.5 2 0.3 0.9\n2 0.4 3 0.2 0.8\n")
    assert [tuple(r)[1:] for r in X.read_segments(spark, p("s.seg")).orderBy("tf").collect()] == [(0, 1, 0.5, 2, 0.3, 0.9), (1, 2, 0.4, 3, 0.2, 0.8)]
    rois = spark.createDataFrame([("L", 1), ("L", 2), ("R", 3)], "roi string, idx int")
    X.write_rois(rois, p("r.rois"))
    assert sorted(map(tuple, X.read_rois(spark, p("r.rois")).collect())) == sorted(map(tuple, rois.collect()))
    (tmp_path / "t.csv").write_text("a,b\n1,-999\n2,3\n")
    assert [tuple(r) for r in X.read_spreadsheet(spark, p("t.csv"), missing=-999).collect()] == [(1, None), (2, 3)]
    (tmp_path / "k.csv").write_text("Cz,1,2,3\nCz,3,2,1\n")
    assert tuple(X.read_krios(spark, p("k.csv")).first()) == ("Cz", 2, 2, 2)
    (tmp_path / "v.vrb").write_text("Trigger 12 at 345: accepted\nnoise\nTrigger 3 at 400: Rejected\n")
    assert sorted(tuple(r)[1:] for r in X.accepted_triggers(spark, p("v.vrb")).collect()) == [(345, True), (400, False)]


def test_names(tmp_path):
    p = str(tmp_path / "MyResults.eeg")
    assert X.output_name(p) == p
    open(p, "w").close()
    assert X.output_name(p).endswith("MyResults_1.eeg") and X.output_name(p, overwrite=True) == p
    open(str(tmp_path / "MyResults_1.eeg"), "w").close()
    assert X.output_name(p).endswith("MyResults_2.eeg") and X.output_name(str(tmp_path / "MyResults_1.eeg")).endswith("MyResults_2.eeg")
    X.verbose(str(tmp_path / "a.vrb"), k=3)
    assert X.read_verbose(str(tmp_path / "a.vrb")) == {"k": 3} and X.resolve("x", "/d") == "/d/x" and X.resolve("/x", "/d") == "/x"
