"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every result is written as
Parquet to the shared folder and read again. All stages but the last return the columns of ``documents``.

Defined results for odd input, in every stage: null text counts as empty; a null id is an id of its own; rows that share an id
are judged by their texts, except that near-duplicates keep one row of each id; texts of any length are read whole; an
empty table gives an empty one; other columns are carried, whatever their names. Without labels of both kinds the first
stage keeps all or none, as the known ones say (all, if there are none).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import byte_bpe, decontamination, minhash_dedup, quality, substring_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, takes for good."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: the one with the smallest id."""
    return minhash_dedup.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out; n_chars follows the text."""
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the SHA-256 of the text decoded from them."""
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_per_class),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = storage.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        storage.clean(spark)
        if last:
            storage.remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
