"""A pipeline of corpus operators over documents; each stage's rows are written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. Documents that fail the quality rules or hold a benchmark window
go, one document of each group of near copies stays, personal data is replaced by its kind, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.llm import bpe, decontamination, ngram_join, pii, quality_rules
from quillworks.llm.common import read, store
from quillworks.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule, or whose host does, go."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a Jaccard similarity of 0.8 or more, the one of least doc_id stays."""
    return ngram_join.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded bytes."""
    return bpe.digests(docs, *tokenizer())


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_copies), ("decontamination", decontaminate), ("pii", redact), ("byte_bpe", encode)]

#: The span classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
