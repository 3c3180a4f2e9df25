"""What the corpus operators share: tables, scratch space that all executors see, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACE = r"\x20\x09-\x0D"

#: Rows up to which a table of a few numbers a row is broadcast.
BROADCAST = 1 << 20

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset (local mode, tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="signaloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark 4.1 and later: shuffle files go when the query that made them ends, not when the driver next collects garbage. Earlier versions do not know it and ignore it.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage is cut and survives lost executors. Its shuffle files are removed once it is written, so those of successive steps do not add up on disk."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number `rid` each, written to the shared folder. Numbers depend on how a scan is split, which changes with the executors at hand; only those written once hold for every later reading."""
    return scratch(rows.withColumn("rid", F.monotonically_increasing_id()), name)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., whose names clash with nothing, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where it has at most BROADCAST rows. df must be a table of a few numbers a row; beyond that bound the join is a plain one."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def word_count(text) -> F.Column:
    """Number of words of a text, in one pass and without an array of them; null counts 0."""
    marks = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(marks)).otherwise(F.lit(0)).cast("long")
