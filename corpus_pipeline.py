"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of `documents`. The rows are those of the stage before, less what the stage
rejects; the mixing stage repeats documents of small sources and loses none (its budget reads the largest source once).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe, exact, jaccard, mixing, quality_rules
from quantloom.storage import materialise

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: How often the mixture may read the smallest source, for one reading of the largest.
REPEAT_LIMIT = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays."""
    return jaccard.one_of_each_group(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat."""
    return mixing.mixed(docs, repeat_limit=REPEAT_LIMIT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text, as counts and digests, one row for each document of the mixture."""
    return bpe.encoding_digests(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: The merges of byte-pair encoding are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
