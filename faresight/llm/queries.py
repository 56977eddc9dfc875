"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faresight.llm import (alignment, fingerprints, hilbert, importance, language_id, licenses, mixing, ngram_join, packing,
                           quality, secret_scan, suffix_dedup, word_table)
from faresight.llm.common import documents

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_report(documents(spark, sf_dir))


@query
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


ORACLE["op5_mix_sources"] = mixing.MIX_SQL


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


@query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(documents(spark, sf_dir))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


@query
def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(documents(spark, sf_dir))


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), bench)
