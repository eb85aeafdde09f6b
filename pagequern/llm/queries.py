"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequern.llm import decontaminate, exact_dedup, html_blocks, jaccard_join, quality, secret_scan, source_mix, suffix_dedup, toxicity, warc_fixity
from pagequern.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.drill(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("spans")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.cluster(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.digest(html_blocks.extract(table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_blocks": op10_html_blocks,
}
