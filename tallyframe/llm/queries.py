"""The queries of this subpackage, one ``opN_<name>`` for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_cnn, kmeans, license_scan, maxscore, mixing, near_dup, packing, pieces, pii, quality_rules, rans, warc_fixity
from .base import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), added=True)


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), added=True, with_ids=False)


def op10_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc_fixity.audit(warc_fixity.warc_records(pages), warc_fixity.warc_records(warc_fixity.damaged(pages)))


def op11_pca_filtered_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_quality_rules, op2_best_fit_packing, op3_minhash_near_dup, op4_hash_threshold_mixing, op5_byte_cnn_quality, op6_skip_chain_pii, op7_patience_license_scan,
        op8_maxscore_top_k, op9_rans_token_files, op10_warc_merkle_audit, op11_pca_filtered_clustering, op12_whole_token_counts, op13_cross_tokenizer_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op1_line_quality_rules": quality_rules.RULES_ORACLE,
    "op3_minhash_near_dup": near_dup.COMPONENTS_ORACLE,
    "op4_hash_threshold_mixing": mixing.MIX_ORACLE,
    "op8_maxscore_top_k": maxscore.TOP_K_ORACLE,
    "op10_warc_merkle_audit": warc_fixity.AUDIT_ORACLE,
    "op11_pca_filtered_clustering": kmeans.CLUSTER_ORACLE,
}
