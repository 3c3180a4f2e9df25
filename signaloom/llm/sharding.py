"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards whose row counts are at most one apart.

Input blocks of at most BLOCK rows are the sending partitions. The driver draws how many rows each block sends to each shard, exactly, from the multivariate hypergeometric law given the shard
sizes; it holds one row of counts per block, no documents. Every block permutes its rows locally and deals them out by its row of the matrix; the exchange follows; each shard permutes
again. The second permutation of a shard is by a random key: key ranges of about RANGE rows are permuted in tasks of their own, and a range's first slot is
the number of rows in earlier ranges. So no task holds a shard.

Rows are numbered and written to the shared folder first, so a task that is repeated after an executor is lost sees the same blocks and draws nothing anew.

Defined results. Null text: size 1, checksum 0. Null or repeated ids and repeated rows: rows like others. Empty table: no rows. Other columns, of any name, are ignored. Fewer rows than shards: some shards are empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, renamed, scratch

BLOCK_BITS, RANGE, SEED = 16, 4_096, 11
MOST = 10**9  # numpy draws hypergeometric numbers below this population


def communication_matrix(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """blocks x shards; row sums are counts, column sums differ by one at most; drawn row by row given what is left."""
    rng, total = np.random.default_rng(seed), sum(counts)
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rows = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        if left.sum() < MOST:
            rows[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:  # n places out of all that are left, without replacement: the same law
            rows[i] = np.bincount(np.searchsorted(np.cumsum(left), rng.choice(int(left.sum()), n, replace=False, shuffle=False), "right"), minlength=shards)
        left -= rows[i]
    return rows


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list:
    """doc_id, size and text_crc32 as columns."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def shuffle_shards(facts: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """A numbered, written table -> its columns, shard, slot."""
    held = facts.columns
    facts = facts.withColumn("block", F.shiftright("rid", BLOCK_BITS))
    blocks = sorted(tuple(r) for r in facts.groupBy("block").count().collect())
    matrix = communication_matrix([n for _, n in blocks], shards, seed)
    dealt = [(b, [int(x) for x in row]) for (b, _), row in zip(blocks, np.cumsum(matrix, 1))]
    dealt = facts.sparkSession.createDataFrame(dealt, "block long, cuts array<long>")  # a row per 65,536 rows of the table or partition

    local = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "rid"), "rid")
    sent = facts.withColumn("place", F.row_number().over(local) - 1).join(dealt, "block")
    sent = sent.withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).cast("int")).drop("cuts", "place", "block")

    ranges = max(1, sum(n for _, n in blocks) // (shards * RANGE))
    sent = sent.withColumn("key", F.xxhash64(F.lit(seed + 1), "rid"))
    sent = sent.withColumn("range", F.shiftright(F.shiftrightunsigned("key", 24) * ranges, 40))
    sent = scratch(sent, "shard-sent")
    starts = sent.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    starts = starts.select("shard", "range", (F.sum("rows").over(W.partitionBy("shard").orderBy("range")) - F.col("rows")).alias("start"))
    again = W.partitionBy("shard", "range").orderBy("key", "rid")
    out = sent.withColumn("at", F.row_number().over(again) - 1).join(starts, ["shard", "range"])
    return out.select(*held, "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is `rows`; it names no shard under growth."""
    return shuffle_shards(numbered(docs.select(*sizes(docs)), "shard-facts"), shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED) -> None:
    """The documents, with all their columns, in Parquet folders path/shard=N (shard_=N and so on where docs has a column of that name), in the order of their slots."""
    held, _ = renamed(docs)
    rows, name = numbered(held, "shard-rows"), "shard"
    while name in map(str.lower, docs.columns):
        name += "_"
    full = rows.join(shuffle_shards(rows.select("rid"), shards, seed), "rid")
    placed = full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(*held.columns, "shard").toDF(*docs.columns, name).write.partitionBy(name).parquet(path)
