"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, mixing.

Every stage reads the Parquet table its predecessor wrote. All stages but the last return the columns of
``documents``; the last adds epoch and position of each drawn row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontam, linededup, mixing, quality, simhash
from wakeline.llm.corpus_queries import MAX_PASSES
from wakeline.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the kept ones lose lines that are frequent on their host."""
    return quality.apply_quality(docs, quality.line_quality(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents left without a word go with them."""
    out = linededup.line_dedup(docs).select(*docs.columns)
    return out.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id; of rows with that id the one with the smallest
    text hash, once. Of a group without any id one row of each fingerprint stays. Null texts are empty; texts without
    words form one group.
    """
    return simhash.keep_one(docs, simhash.simhash_groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null and empty texts overlap none and stay; rows with one id and one text
    go or stay together; null and short items and an empty benchmark take nothing away."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again, up to MAX_PASSES passes."""
    return mixing.mix(docs, max_passes=MAX_PASSES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("temperature_mixing", mix_sources),
]

# XXH64 and SimHash have no SQL counterpart; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
