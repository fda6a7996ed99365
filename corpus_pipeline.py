"""The corpus pipeline: five stages from raw documents to token files, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import blocks, decontam, jaccard, mixing, quality, tokenstore
from quire.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixing.repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenstore.token_output(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
    ("token output", token_output),
]

#: The trees, the cube method and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against
#: a plain version of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token files' rows; what the stages wrote before the files is removed once these are there."""
    begun = len(blocks.made())
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    out = STAGES[-1][1](spark, docs, sf_dir)
    blocks.drop(spark, begun, keep=("segments",))
    return out
