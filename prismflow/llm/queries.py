"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismflow import storage
from prismflow.llm import byte_bpe, chat_format, decontamination, license_scan, minhash_dedup, neighbours, quality, simhash_dedup, substring_dedup, tandem_runs, token_files, url_filter
from prismflow.llm.oracles import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the registered url query: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Both turns of the extra conversation say this.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.link_edges(pages), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat_format.digests(chat_format.formatted_turns(chat_format.text_parts(rows.unionByName(extra))))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    found = storage.cut(token_files.digests(spark, path))
    storage.remove(spark, path)
    return found


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(_table(spark, sf_dir, "documents"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem_runs.digests(tandem_runs.with_periods(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_decontamination,
        op3_chat_format,
        op4_byte_bpe,
        op5_minhash_near_dedup,
        op6_token_files,
        op7_quality,
        op8_substring_dedup,
        op9_license_scan,
        op10_neighbours,
        op11_simhash_dedup,
        op12_tandem_runs,
    )
}

__all__ = ["ORACLE", "QUERIES"]
