"""The corpus queries by name, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import (
    bpe,
    classifier,
    decontamination,
    exact,
    jaccard,
    language,
    licenses,
    merkle,
    mixing,
    quality_rules,
    resampling,
    warc,
    wrapper,
)
from quantloom.llm.oracles import ORACLES
from quantloom.storage import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
REPEAT_LIMIT = 2.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *counts, "base_failed", (F.round("ratio", 6) + F.lit(0.0)).alias("ratio"), "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "n_unknown",
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies_of_each(_table(spark, sf_dir, "documents"), repeat_limit=REPEAT_LIMIT)
    return found.select(
        "row.doc_id", "source", "n_tokens", F.round("alpha", 6).alias("alpha"), F.round("weight", 6).alias("weight"), "copies"
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is tampered with: its text goes to lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(_table(spark, sf_dir, "documents"), tampered, merkle.lower_ascii(F.col("text")))
    return found.withColumn("proof_sha256", F.sha2("proof", 256)).drop("proof")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_rules,
        op3_warc,
        op4_jaccard_join,
        op5_html_extraction,
        op6_license_scan,
        op7_bpe,
        op8_mixing,
        op9_quality_classifier,
        op10_exact_dedup,
        op11_importance_resampling,
        op12_merkle_manifest,
        op13_decontamination,
    )
} | {"pipeline": corpus_pipeline.run}

CORPUS_ORACLES: dict[str, str] = dict(ORACLES)
