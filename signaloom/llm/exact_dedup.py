"""Exact deduplication: 128-bit content hash, then the bytes.

Two texts are equal when they are identical after every space, tab, line feed, vertical tab, form feed and carriage return is deleted.

Plan. (1) Rows are numbered and written to the shared folder once, with code points of the original text, 128-bit hash (MD5) and SHA-256 of the normalised text; all later steps read that
table, so numbers hold whatever becomes of executors. (2) Keepers: slim facts grouped by hash, with map-side partial aggregation, so that a group of any size sends one row per task. (3) Byte
check: only texts whose hash occurs twice or more are grouped by (hash, bytes), again with partial aggregation; other texts are not shuffled while the repeated hashes are few enough to be broadcast
(common.BROADCAST rows of one number, checked), and join them beyond. A hash that holds several byte strings is split, and equal pairs of hashes over different bytes raise an error. (4) Facts join
the keepers of groups of two rows or more, which are written to the shared folder first: rows are slim, and the hot partitions of the join are split by adaptive execution.

Defined results. Null text: as the empty text. Empty and white-space texts: one group. Null ids: order after all others. Repeated rows (same id, same text): one of them
stays. Empty table: no rows. Other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, few, numbered, renamed, scratch


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def md5_128(text) -> F.Column:
    return F.unhex(F.md5(text))


def _facts(rows: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """rows, numbered and written, with points, hash, sha and the first eight bytes of the hash as a number."""
    made = rows.withColumn("points", F.length(F.coalesce(F.col(text_col), F.lit("")))).withColumn("norm", normalised(F.col(text_col)))
    made = made.withColumn("hash", digest(F.col("norm"))).withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm")
    return numbered(made, "exact-rows")


def _head(hash_col) -> F.Column:
    return F.xxhash64(hash_col)


def exact_groups(rows: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """One row per row of a table that _facts made: rid, doc_id, keep_id, keep_rid, group_size, kept, sha (binary SHA-256)."""
    facts = rows.select("rid", F.col(id_col).alias("doc_id"), "points", "hash", "sha")
    first = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    keepers = scratch(facts.groupBy("hash", "sha").agg(F.count("*").alias("n"), F.min(first).alias("first")).filter("n > 1"), "exact-keepers")
    repeated = scratch(keepers.select(_head("hash").alias("head")).distinct(), "exact-repeated")
    texts = rows.select(_head("hash").alias("head"), "hash", F.col(text_col).alias("text")).join(few(repeated), "head", "left_semi")
    spelled = texts.groupBy("hash", normalised(F.col("text")).alias("norm")).agg(F.count("*").alias("rows")).filter("rows > 1")
    spelled = spelled.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "rows")
    # A group of n rows is confirmed when n rows hold one and the same byte string.
    confirmed = keepers.join(spelled, ["hash", "sha"], "left").select(
        "hash", "sha", "first", F.when(F.col("rows") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("different texts share both digests")).cast("long")).alias("n")
    )
    # Read from a table, not from its aggregation, both sides of the join are plain exchanges, whose hot partitions adaptive execution can split.
    grouped = facts.join(scratch(confirmed, "exact-groups"), ["hash", "sha"], "left")
    return grouped.select(
        "rid",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce(F.col("first.rid"), F.col("rid")).alias("keep_rid"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce(F.col("first.rid"), F.col("rid")) == F.col("rid")).alias("kept"),
        "sha",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=md5_128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too."""
    rows = _facts(docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), "c0", "c1", digest)
    return exact_groups(rows, "c0", "c1", digest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns."""
    held, name = renamed(docs)
    rows = _facts(held, name[id_col], name[text_col], md5_128)
    gone = scratch(exact_groups(rows, name[id_col], name[text_col], md5_128).filter("not kept").select("rid"), "exact-gone")
    return rows.join(few(gone), "rid", "left_anti").select(*held.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by length(raw) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
