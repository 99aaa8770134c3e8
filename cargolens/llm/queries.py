"""Queries of this subpackage for the entry module: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, licenses, lm_scoring, minhash, mixing, packing, quality, ranking, secrets, substrings, topk, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op9(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op5(_table(spark, sf_dir, "documents"))


def op6_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op6(_table(spark, sf_dir, "embeddings"))


def op2_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2(_table(spark, sf_dir, "documents"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(_table(spark, sf_dir, "documents"))


def op1_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.op7(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(_table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op12(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.op13(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_knn_toxicity": op1_knn_toxicity,
    "op2_cutting_stock_packing": op2_cutting_stock_packing,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_nra_top_k": op6_nra_top_k,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_ranked_search": op13_ranked_search,
}
SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op6_nra_top_k": topk.OP6_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
    "op9_minhash_near_dedup": minhash.OP9_SQL,
    "op13_ranked_search": ranking.OP13_SQL,
}
