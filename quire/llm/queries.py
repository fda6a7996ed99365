"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cms, decontam, html, importance, jaccard, license, lpf, merkle, mixing, quality, tokencount, tokenstore, twins, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.dedup_substrings(table(spark, sf_dir, "documents"), 50)


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_count_min_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cms.dedup_windows(table(spark, sf_dir, "documents"), 13)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_output(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_cube_mixing, op3_suffix_array_dedup, op4_spaced_seed_decontamination, op5_count_min_dedup, op6_html_extraction, op7_license_scan, op8_token_output, op9_token_counts, op10_jaccard_join, op11_merkle_manifest, op12_importance_resampling, op13_warc_conversion)
}
ORACLE_SQL: dict[str, str] = dict(twins.ORACLE_SQL)
