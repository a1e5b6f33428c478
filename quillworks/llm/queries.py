"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.llm import bpe, decontamination, html_text, license_scan, ngram_join, pii, quality_rules, repeats, revisits, sharding
from quillworks.llm.common import read


def tokenizer() -> tuple[str, str]:
    """The rank file and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), *tokenizer())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_sets(read(spark, sf_dir, "documents"), 4, 85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.report(read(spark, sf_dir, "pages"))


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 24)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts_of_documents(read(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_byte_bpe, op2_ngram_jaccard, op3_suffix_dedup, op4_license_scan, op5_html_text, op6_decontamination, op7_revisits, op8_bin_packing, op9_pii, op10_quality_rules)
    return {f.__name__: f for f in own}
