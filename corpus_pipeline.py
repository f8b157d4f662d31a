"""From raw documents to packed sequences: the stages of a training corpus.

Defined cases, for every stage: null and empty texts go through as empty ones (the
quality classifier decides on them like on others; all of them are copies of each
other in near_dedup); null ids are ids like others; repeated rows are copies, of which
one stays; very long texts are worked on whole; columns besides those of ``documents``
are kept but by the last stage, whatever their names; ties go to the smallest id; an
empty table gives an empty one.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last give
back the columns of ``documents``. The result of a stage is written as Parquet and
read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import bagminhash, byte_cnn, common, decontaminate, packing, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return byte_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return bagminhash.keep_one(docs)


def suffix_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur elsewhere, of the length that any passage of over 50 words has."""
    return suffix_dedup.without_repeats(docs, length=suffix_dedup.PASSAGE, gram=suffix_dedup.PASSAGE // 4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, so the tests hold the stages against brute force.
ORACLE_SQL = None
