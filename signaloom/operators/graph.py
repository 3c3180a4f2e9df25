"""Connected components and written intermediate tables for operators that iterate."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read again; a folder of its own only where that is unset (local mode)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="signaloom-")
        _own[spark.sparkContext.applicationId] = folder
    path = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, write=written) -> DataFrame:
    """edges (a, b of any type that has an order) -> node, root: the smallest node that each node reaches, for nodes that have an edge.

    Large-star and small-star steps after Kiveris et al. 2014: about log^2 n rounds at worst, few on star-like graphs. Every round is written; the smallest neighbours are written before they join,
    so that both sides of the join are plain exchanges and adaptive execution can split a hub's rows.
    """

    def star(edges):
        return edges.join(write(edges.groupBy("a").agg(F.min("b").alias("m"))), "a")

    now, mark = write(_downward(edges)), None
    while True:  # every round but the last ties nodes to smaller ones, so there is a last
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _downward(star(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        starred = star(large)
        small = starred.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(starred.select("a", F.col("m").alias("b")))
        now = write(_downward(small))
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
