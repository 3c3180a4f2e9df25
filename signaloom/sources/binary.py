"""Binary formats from their public specifications: EDF and BDF, BrainVision, NIfTI-1 and Analyze 7.5.

A recording's header is read on the driver; its data in tasks that each read a range of records or frames by offset, so a long recording is not one task's work. Paths are local or on a
mounted store, as the tasks open them.
"""

from __future__ import annotations

import configparser
import gzip
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RANGE = 4 << 20
TRACKS = "rec string, tf long, track int, value double"


def _ranges(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, len(rows)))


def _long(rec, start, data):
    """frames x tracks -> an Arrow batch of rec, tf, track, value."""
    frames, tracks = data.shape
    return pa.RecordBatch.from_arrays(
        [pa.array([rec] * data.size), pa.array(np.repeat(np.arange(start, start + frames), tracks)), pa.array(np.tile(np.arange(tracks, dtype=np.int32), frames)), pa.array(data.reshape(-1).astype(float))], ["rec", "tf", "track", "value"]
    )


# --- EDF (16 bits) and BDF (24 bits) ------------------------------------------------------------------------------------------------------------------------------------------


def edf_header(path: str) -> dict:
    with open(path, "rb") as f:
        fixed = f.read(256)
        n = int(fixed[252:256])
        rest = f.read(256 * n)
    widths, at, fields = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32), 0, []
    for w in widths:
        fields.append([rest[at + k * w : at + (k + 1) * w].decode("latin-1").strip() for k in range(n)])
        at += n * w
    return {
        "bytes": 3 if fixed[0] == 255 else 2, "header": int(fixed[184:192]), "records": int(fixed[236:244]), "seconds": float(fixed[244:252]), "labels": fields[0],
        "physical": [(float(a), float(b)) for a, b in zip(fields[3], fields[4])], "digital": [(float(a), float(b)) for a, b in zip(fields[5], fields[6])], "samples": [int(x) for x in fields[8]],
    }


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """rec, tf, track, value in physical units; all signals must have one sampling rate."""
    h = edf_header(path)
    if len(set(h["samples"])) != 1:
        raise ValueError("signals of several sampling rates")
    size, n, per = h["bytes"] * sum(h["samples"]), len(h["samples"]), h["samples"][0]
    records = h["records"] if h["records"] >= 0 else (os.path.getsize(path) - h["header"]) // size
    step = max(1, RANGE // size)

    def run(batches):
        gain = np.array([(p[1] - p[0]) / (d[1] - d[0]) for p, d in zip(h["physical"], h["digital"])])
        zero = np.array([p[0] - d[0] * g for p, d, g in zip(h["physical"], h["digital"], gain)])
        for b in batches:
            for first, count in zip(b.column("first").to_pylist(), b.column("count").to_pylist()):
                with open(path, "rb") as f:
                    f.seek(h["header"] + first * size)
                    raw = np.frombuffer(f.read(count * size), np.uint8)
                if h["bytes"] == 2:
                    x = raw.view("<i2").astype(float)
                else:
                    t = raw.reshape(-1, 3).astype(np.int32)
                    x = t[:, 0] | t[:, 1] << 8 | t[:, 2] << 16
                    x = np.where(x >= 1 << 23, x - (1 << 24), x).astype(float)
                x = x.reshape(count, n, per).transpose(0, 2, 1).reshape(-1, n)
                yield _long(path, first * per, x * gain + zero)

    return _ranges(spark, [(k, min(step, records - k)) for k in range(0, records, step)], "first long, count long").mapInArrow(run, TRACKS)


def write_edf(df: DataFrame, path: str, rate: int, labels: list[str], low: float, high: float, bits: int = 16) -> None:
    """One recording tf, track, value as EDF (16 bits) or BDF (24), a record per second; the last is padded. Rows stream to the driver in order, a record at a time."""
    n, top, width = len(labels), (1 << bits - 1) - 1, bits // 8
    pad = lambda x, w: str(x)[:w].ljust(w).encode("latin-1")
    records = 0
    with open(path, "wb") as f:
        f.write(b"\0" * 256 * (n + 1))
        frame = np.zeros((rate, n))

        def flush():
            q = np.clip(np.round((frame - low) / (high - low) * (2 * top + 1) - top - 1), -top - 1, top).astype("<i4")
            f.write(np.ascontiguousarray(q.T).view(np.uint8).reshape(n, rate, 4)[:, :, :width].tobytes())

        for r in df.select("tf", "track", "value").orderBy("tf", "track").toLocalIterator():
            while r["tf"] >= (records + 1) * rate:
                flush()
                frame[:] = 0
                records += 1
            frame[r["tf"] - records * rate, r["track"]] = r["value"]
        flush()
        records += 1
        first = (b"\xffBIOSEMI" if bits == 24 else pad("0", 8)) + pad("", 160) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("24BIT" if bits == 24 else "", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
        per = [(16, labels), (80, [""] * n), (8, ["uV"] * n), (8, [f"{low:g}"] * n), (8, [f"{high:g}"] * n), (8, [-top - 1] * n), (8, [top] * n), (80, [""] * n), (8, [rate] * n), (32, [""] * n)]
        f.seek(0)
        f.write(first + b"".join(pad(v, w) for w, values in per for v in values))


# --- BrainVision --------------------------------------------------------------------------------------------------------------------------------------------------------------


def brainvision_header(path: str) -> dict:
    text = open(path, encoding="utf-8", errors="replace").read()
    ini = configparser.ConfigParser(strict=False, interpolation=None)
    ini.read_string(text[text.index("[") :].split("[Comment]")[0])
    common, channels = ini["Common Infos"], ini["Channel Infos"]
    parts = [channels[f"ch{k}"].split(",") for k in range(1, int(common["NumberOfChannels"]) + 1)]
    return {
        "data": os.path.join(os.path.dirname(path), common["DataFile"]), "rate": 1e6 / float(common["SamplingInterval"]), "names": [p[0] for p in parts], "gain": [float(p[2] or 1) if len(p) > 2 else 1.0 for p in parts],
        "kind": {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[ini["Binary Infos"]["BinaryFormat"]], "multiplexed": common.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED", "markers": common.get("MarkerFile"),
    }


def read_brainvision(spark: SparkSession, path: str) -> DataFrame:
    """rec, tf, track, value of a multiplexed recording, by its .vhdr."""
    h = brainvision_header(path)
    if not h["multiplexed"]:
        raise ValueError("only multiplexed data")
    n, width = len(h["names"]), np.dtype(h["kind"]).itemsize
    frames, step = os.path.getsize(h["data"]) // (n * width), max(1, RANGE // (n * width))

    def run(batches):
        for b in batches:
            for first, count in zip(b.column("first").to_pylist(), b.column("count").to_pylist()):
                with open(h["data"], "rb") as f:
                    f.seek(first * n * width)
                    x = np.frombuffer(f.read(count * n * width), h["kind"]).reshape(count, n)
                yield _long(path, first, x * np.array(h["gain"]))

    return _ranges(spark, [(k, min(step, frames - k)) for k in range(0, frames, step)], "first long, count long").mapInArrow(run, TRACKS)


def read_brainvision_markers(spark: SparkSession, path: str) -> DataFrame:
    """from_tf, to_tf, kind, name of a .vmrk file."""
    from pyspark.sql import functions as F

    part = F.split(F.regexp_extract("value", r"^Mk\d+=(.*)$", 1), ",")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^Mk\d+="))
    first = part[2].cast("long") - 1
    return rows.select(first.alias("from_tf"), (first + F.greatest(part[3].cast("long"), F.lit(1)) - 1).alias("to_tf"), part[0].alias("kind"), part[1].alias("name"))


def write_brainvision(df: DataFrame, path: str, rate: float, names: list[str]) -> None:
    """path.vhdr and path.eeg (32-bit floats) of one recording tf, track, value; rows stream to the driver in order."""
    with open(path + ".eeg", "wb") as f:
        frame, at = np.zeros(len(names), "<f4"), 0
        for r in df.select("tf", "track", "value").orderBy("tf", "track").toLocalIterator():
            while r["tf"] > at:
                f.write(frame.tobytes())
                frame[:] = 0
                at += 1
            frame[r["track"]] = r["value"]
        f.write(frame.tobytes())
    channels = "".join(f"Ch{k}={name},,1,uV\n" for k, name in enumerate(names, 1))
    with open(path + ".vhdr", "w") as f:
        f.write(
            f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nCodepage=UTF-8\nDataFile={os.path.basename(path)}.eeg\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels={len(names)}\nSamplingInterval={1e6 / rate:g}\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\n{channels}"
        )


# --- NIfTI-1 and Analyze 7.5 --------------------------------------------------------------------------------------------------------------------------------------------------

_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def _open(path):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def volume_header(path: str) -> dict:
    with _open(path) as f:
        head = f.read(348)
    order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", head[40:56])
    nifti = head[344:347] in (b"n+1", b"ni1")
    slope, inter = struct.unpack(order + "2f", head[112:120]) if nifti else (0.0, 0.0)
    data, offset = path, int(struct.unpack(order + "f", head[108:112])[0])
    if path.endswith(".hdr"):
        data, offset = path[:-4] + ".img", max(0, offset)
    return {"dim": [max(1, d) for d in dim[1:5]], "kind": order + _KINDS[struct.unpack(order + "h", head[70:72])[0]], "offset": offset, "data": data, "slope": slope or 1.0, "inter": inter if slope else 0.0, "size": struct.unpack(order + "8f", head[76:108])[1:4]}


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """vol, t, x, y, z, v of .nii, .nii.gz or .hdr/.img; tasks read ranges of slices (a packed file is read from its start by each)."""
    h = volume_header(path)
    nx, ny, nz, nt = h["dim"]
    width = np.dtype(h["kind"]).itemsize
    step = max(1, RANGE // (nx * ny * width))
    if path.endswith(".gz"):
        step = nz * nt

    def run(batches):
        for b in batches:
            for first, count in zip(b.column("first").to_pylist(), b.column("count").to_pylist()):
                with _open(h["data"]) as f:
                    f.seek(h["offset"] + first * nx * ny * width)
                    v = np.frombuffer(f.read(count * nx * ny * width), h["kind"]).astype(float) * h["slope"] + h["inter"]
                i = np.arange(len(v))
                s = first + i // (nx * ny)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(v)), *(pa.array(c.astype(np.int32)) for c in (s // nz, i % nx, i // nx % ny, s % nz)), pa.array(v)], ["vol", "t", "x", "y", "z", "v"])

    slices = nz * nt
    return _ranges(spark, [(k, min(step, slices - k)) for k in range(0, slices, step)], "first long, count long").mapInArrow(run, "vol string, t int, x int, y int, z int, v double")


def write_volume(df: DataFrame, path: str, dim: tuple[int, ...], voxel=(1.0, 1.0, 1.0), kind: str = "f4") -> None:
    """One NIfTI-1 volume (or series, with t) x, y, z, v; missing voxels are 0. Rows stream to the driver a slice at a time."""
    nx, ny, nz, nt = (*dim, 1)[:4]
    code = {v: k for k, v in _KINDS.items()}[kind]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4 if nt > 1 else 3, nx, ny, nz, nt, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(kind).itemsize)
    struct.pack_into("<8f", head, 76, 1.0, *voxel, 1.0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    rows = df.select(*(["t"] if "t" in df.columns else []), "z", "y", "x", "v").orderBy(*(["t"] if "t" in df.columns else []), "z", "y", "x").toLocalIterator()
    with (gzip.open(path, "wb") if path.endswith(".gz") else open(path, "wb")) as f:
        f.write(bytes(head))
        at, sheet = 0, np.zeros((ny, nx))

        def flush():
            f.write((sheet if kind.startswith("f") else np.round(sheet)).astype("<" + kind).tobytes())
            sheet[:] = 0

        for r in rows:
            s = (r["t"] if "t" in df.columns else 0) * nz + r["z"]
            while at < s:
                flush()
                at += 1
            sheet[r["y"], r["x"]] = r["v"]
        while at < nz * nt:
            flush()
            at += 1


