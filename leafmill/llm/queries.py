"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, dualtree, fingerprints, hamming, licenses, mixing, packing, quality, simhash, suffixes, tokenfiles, toxicity, winnowing


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.digest(table(spark, sf_dir, "embeddings"))


def op8_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(spark, sf_dir, "documents"))


def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digest(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.digest(table(spark, sf_dir, "embeddings"))


def op13_union_find_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_importance_resampling, op4_cost_balanced_packing, op5_entropy_balanced_mix, op6_anchor_simhash, op7_multi_index_hashing, op8_one_permutation_minhash, op9_huffman_token_files, op10_kneser_ney_toxicity, op11_winnowing_decontamination, op12_dual_tree_negatives, op13_union_find_alignment)}

#: DuckDB SQL for the same rows, where it can express them.
ORACLE: dict[str, str] = {"op7_multi_index_hashing": hamming.SQL, "op11_winnowing_decontamination": winnowing.SQL, "op12_dual_tree_negatives": dualtree.SQL}
