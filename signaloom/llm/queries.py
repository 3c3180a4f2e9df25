"""Registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import exact_dedup, language, license, mixing, near_embed, ngram_join, packing, sharding, toxicity, warc
from .common import table


def op1_license_scan(spark, sf_dir):
    return license.license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language.language_id(table(spark, sf_dir, "documents"))


def op3_bm25_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_weighted_fair_mix(spark, sf_dir):
    return mixing.weighted_fair_mix(table(spark, sf_dir, "documents"))


def op5_hypergeometric_shards(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_cross_polytope_near_dedup(spark, sf_dir):
    return near_embed.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, threshold="90/100")


QUERIES = (op1_license_scan, op2_language_id, op3_bm25_packing, op4_weighted_fair_mix, op5_hypergeometric_shards, op6_toxicity, op7_cross_polytope_near_dedup, op8_exact_dedup, op9_warc_round_trip, op10_ngram_jaccard_join)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op1_license_scan": license.oracle_sql(), "op4_weighted_fair_mix": mixing.ORACLE_SQL, "op7_cross_polytope_near_dedup": near_embed.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op9_warc_round_trip": warc.ORACLE_SQL, "op10_ngram_jaccard_join": ngram_join.ORACLE_SQL}
