"""The operators of this subpackage as named queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm import alignment, language_model, mixing, near_duplicates, nearest, oracles, packing, passages, quality, repeats, secrets, templates, token_files, whitening
from shelfwatch.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_quality_rules": oracles.QUALITY, "op4_mix_sources": oracles.MIXING}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(documents(spark, sf_dir))


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.grouped(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicated(documents(spark, sf_dir), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, F.col("vec_id") % 20 == 0)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(documents(spark, sf_dir))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.counts(documents(spark, sf_dir))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.without_recurring(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = packing.packed(documents(spark, sf_dir), with_ids=False)
    return plan.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(documents(spark, sf_dir))


@query
def op13_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
