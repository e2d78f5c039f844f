"""The registered queries of this folder: one thin query per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, hist_shard, html_cut, line_chunks, packing, parity_join, periodic_runs, robust_quality, secret_layers, substring_dedup, toxicity,
    url_rules, whitening,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_text(_read(spark, sf_dir, "pages"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_chunks.remove_repeats(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_shard.place(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.judge(_read(spark, sf_dir, "documents")).withColumn("distance", F.round("distance", 6))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_layers.scan(_read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_ngram_jaccard_join, op3_html_extraction, op4_url_filters, op5_toxicity, op6_line_dedup,
        op7_benchmark_decontamination, op8_sharding, op9_quality_rules, op10_secret_scans, op11_embedding_whitening,
        op12_substring_dedup, op13_periodic_run_detection, pipeline,
    )
}
ORACLES: dict[str, str] = {"op4_url_filters": url_rules.oracle(), "op7_benchmark_decontamination": decontam.oracle()}
