"""Text formats: tracks (.ep, .eph), electrodes (.xyz, .els, .loc), markers (.mrk), segments (.seg), regions (.rois), spreadsheets, verbose files. Readers return DataFrames; large ones are read by splits."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path) -> DataFrame:
    """rec, line (0-based), value. A file of text is numbered as a whole: formats without time in their rows need the order of lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rec"), F.regexp_replace("value", r"\r", "").alias("value"))
    return whole.select("rec", F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("line", "value"))


def read_tracks(spark: SparkSession, path, header: bool = False) -> DataFrame:
    """rec, tf, track, value of .ep files, or of .eph files, whose first line has the numbers of tracks and frames and the sampling frequency."""
    lines = _lines(spark, path)
    skip = 1 if header else 0
    cells = lines.filter((F.col("line") >= skip) & (F.trim("value") != "")).select("rec", (F.col("line") - skip).cast("long").alias("tf"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("track", "text"))
    return cells.select("rec", "tf", "track", F.col("text").try_cast("double").alias("value"))


def read_eph_headers(spark: SparkSession, path) -> DataFrame:
    """rec, tracks, frames, rate."""
    part = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).filter("line = 0").select("rec", part[0].cast("int").alias("tracks"), part[1].cast("long").alias("frames"), part[2].cast("double").alias("rate"))


def write_tracks(df: DataFrame, path: str) -> None:
    """A text row per frame, frames in order within and across part files; tf, track, value of one recording."""
    rows = df.groupBy("tf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "value"))), lambda s: s["value"].cast("string")), "\t").alias("value"))
    rows.orderBy("tf").select("value").write.text(path)


def read_points(spark: SparkSession, path, kind: str = "xyz") -> DataFrame:
    """set_id, idx, x, y, z, name. xyz: a header line, then x y z name; loc: name x y z without a header."""
    lines = _lines(spark, path).filter(F.trim("value") != "")
    lines = lines.filter("line > 0") if kind == "xyz" else lines
    part, at = F.split(F.trim("value"), r"\s+"), (0 if kind == "xyz" else 1)
    first = 1 if kind == "xyz" else 0
    coordinates = [part[at + k].try_cast("double").alias(n) for k, n in enumerate("xyz")]
    name = F.try_element_at(part, F.lit(4)) if kind == "xyz" else part[0]
    return lines.select(F.col("rec").alias("set_id"), (F.col("line") - first).cast("int").alias("idx"), *coordinates, name.alias("name"))


def write_points(df: DataFrame, path: str) -> None:
    """One .xyz file of one set (a few hundred points), through the driver."""
    rows = df.orderBy("idx").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 points")
    with open(path, "w") as f:
        f.write(f"{len(rows)} 1.0\n" + "".join(f"{r['x']:.6f}\t{r['y']:.6f}\t{r['z']:.6f}\t{r['name']}\n" for r in rows))


def read_markers(spark: SparkSession, path) -> DataFrame:
    """rec, from_tf, to_tf, name of .mrk files: rows of two frames and a name in quotes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("rec"), "value")
    found = [F.regexp_extract("value", r'^\s*(\d+)\s+(\d+)\s+"?([^"]*)"?\s*$', k) for k in (1, 2, 3)]
    rows = lines.select("rec", found[0].alias("a"), found[1].alias("b"), found[2].alias("name")).filter("a <> ''")
    return rows.select("rec", F.col("a").cast("long").alias("from_tf"), F.col("b").cast("long").alias("to_tf"), "name")


def write_markers(df: DataFrame, path: str) -> None:
    row = F.concat(F.col("from_tf").cast("string"), F.lit("\t"), F.col("to_tf").cast("string"), F.lit('\t"'), "name", F.lit('"'))
    df.orderBy("from_tf", "to_tf").select(row.alias("value")).write.text(path)


def read_segments(spark: SparkSession, path) -> DataFrame:
    """rec, tf, gfp, dis, seg, gev, corr of .seg files: five tracks per file after a header line."""
    cells = read_tracks(spark, path, header=True)
    pick = lambda k: F.max(F.when(F.col("track") == k, F.col("value")))
    return cells.groupBy("rec", "tf").agg(pick(0).alias("gfp"), pick(1).alias("dis"), pick(2).cast("int").alias("seg"), pick(3).alias("gev"), pick(4).alias("corr"))


def read_rois(spark: SparkSession, path) -> DataFrame:
    """roi, idx of JSON lines {"name": ..., "members": [...]}."""
    return spark.read.schema("name string, members array<int>").json(path).select(F.col("name").alias("roi"), F.explode("members").alias("idx"))


def write_rois(df: DataFrame, path: str) -> None:
    df.groupBy(F.col("roi").alias("name")).agg(F.array_sort(F.collect_list("idx")).alias("members")).write.json(path)


def read_spreadsheet(spark: SparkSession, path, schema: str | None = None, missing: float | None = None) -> DataFrame:
    """CSV with a header; a sentinel number for missing values becomes null."""
    df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
    if missing is not None:
        df = df.select(*[F.nullif(c, F.lit(missing)).alias(c) if t in ("double", "int", "bigint", "float") else c for c, t in df.dtypes])
    return df


def read_krios(spark: SparkSession, path) -> DataFrame:
    """name, x, y, z: the mean of each named point of a scanner's CSV (name, x, y, z without a header)."""
    rows = spark.read.schema("name string, x double, y double, z double").csv(path)
    return rows.filter("x is not null").groupBy("name").agg(*[F.avg(c).alias(c) for c in "xyz"])


def verbose(path: str, **parameters) -> None:
    """Parameters and results of a run beside its output, as JSON."""
    with open(path, "w") as f:
        json.dump(parameters, f, indent=1, sort_keys=True, default=str)


def read_verbose(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def accepted_triggers(spark: SparkSession, path) -> DataFrame:
    """rec, tf, accepted of verbose text with rows such as `Trigger 12 at 345: accepted`."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("rec"), "value")
    pattern = r"(?i)trigger\s+\S+\s+at\s+(\d+)\s*:\s*(accepted|rejected)"
    return lines.filter(F.col("value").rlike(pattern)).select("rec", F.regexp_extract("value", pattern, 1).cast("long").alias("tf"), (F.lower(F.regexp_extract("value", pattern, 2)) == "accepted").alias("accepted"))


def output_name(path: str, overwrite: bool = False) -> str:
    """The path itself, or with _1, _2, ... where it exists and may not be overwritten; a number at the end counts on."""
    if overwrite or not os.path.exists(path):
        return path
    stem, ext = os.path.splitext(path)
    base, at = (m[1], int(m[2])) if (m := re.fullmatch(r"(.*)_(\d+)", stem)) else (stem, 0)
    while os.path.exists(f"{base}_{at + 1}{ext}"):
        at += 1
    return f"{base}_{at + 1}{ext}"


def resolve(name: str, folder: str | None, create: bool = False) -> str:
    """A relative name against an input or output folder."""
    if create and folder:
        os.makedirs(folder, exist_ok=True)
    return name if os.path.isabs(name) or not folder else os.path.join(folder, name)


def link_many(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents that belong together, by a JSON manifest {name: {"format": ..., "path": ...}}, registered as views."""
    out = {}
    for name, doc in read_verbose(path).items():
        out[name] = spark.read.format(doc["format"]).load(doc["path"])
        out[name].createOrReplaceTempView(name)
    return out
