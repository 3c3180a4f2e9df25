"""Commands on small recordings and from a shell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signaloom.plans import commands as C
from signaloom.sources import binary


def recording(spark):
    return spark.range(64).select(F.lit("r").alias("rec"), F.col("id").alias("tf"), F.posexplode(F.array(*[F.sin(F.col("id") * (k + 1) / 8.0) for k in range(4)])).alias("track", "value"))


def test_reprocess(spark):
    df = recording(spark)
    out = C.reprocess_tracks(df, "0-2", first=8, last=40, rate=64.0, dc=True, low=20.0, notch=25.0, reference="0", baseline=(8, 12), threshold=(-1, 1), envelope=1, ratio=2)
    assert {r.track for r in out.collect()} == {0, 1, 2} and out.filter("track = 0").agg(F.max(F.abs("value"))).first()[0] == pytest.approx(0)
    assert C.reprocess_tracks(df, average=True).count() == 4
    rois = spark.createDataFrame([("front", 0), ("front", 1)], "roi string, idx int")
    assert C.reprocess_tracks(df, rois=rois, ranking=True, rectify=True).select("track").distinct().first()[0] == "front"


def test_interpolation_is_exact_for_smooth_fields(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(40, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    df = spark.createDataFrame([("r", 0, k, float(p[k, 2])) for k in range(40)], "rec string, tf long, track int, value double")
    out = {r.track: r.value for r in C.interpolate_tracks(df, p, [3, 9]).collect()}
    assert len(out) == 40 and out[3] == pytest.approx(p[3, 2], abs=0.05) and out[9] == pytest.approx(p[9, 2], abs=0.05)


def test_frequency_and_source(spark):
    out = C.frequency_analysis(recording(spark), 32, 16, hanning=True, average=True, bands="1-3; 4-8")
    assert {r.band for r in out.collect()} == {"1-3", "4-8"}
    inverse = spark.createDataFrame([(s, a, e, float(s + a == e)) for s in range(2) for a in range(3) for e in range(4)], "sp int, axis int, e int, w double")
    ris = C.computing_ris(recording(spark), inverse)
    assert ris.count() == 128 and C.computing_ris(recording(spark), inverse, zscore=True).agg(F.avg("v")).first()[0] == pytest.approx(0, abs=1e-9)
    cube = spark.createDataFrame([(k, k % 2, k // 2 % 2, k // 4) for k in range(8)], "idx int, x int, y int, z int")
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0)], "idx int, x double, y double, z double")
    vol = C.ris_to_volume(ris, cube, points)
    assert vol.count() == 64 * 8


def test_shell(spark, tmp_path):
    binary.write_edf(recording(spark), str(tmp_path / "a.edf"), 32, list("ABCD"), -2, 2)
    run = ["reprocesstracks", "--input-dir", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--tracks", "0,1", "--reference", "average", "--verbose", "a.edf"]
    C.main(run)
    C.main(run)
    C.main(["frequencyanalysis", "--input-dir", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--size", "16", "--step", "8", "a.edf"])
    assert spark.read.parquet(str(tmp_path / "out" / "a.edf.reprocesstracks_1.parquet")).count() == 128
    assert spark.read.parquet(str(tmp_path / "out" / "a.edf.frequencyanalysis.parquet")).count() > 0
