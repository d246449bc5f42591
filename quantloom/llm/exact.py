"""Exact deduplication by skew-safe combining.

Texts are the same when they are identical after each run of white space became one blank; NULL counts as empty.
Three steps, each grouping by the full content beside its digest:

1. every task combines the equal texts it has read (the partial aggregate of the first grouping);
2. groups of (digest, salt) are merged, the salt being drawn from the document's id, so a text that a third of all
   documents share is spread over `salts` tasks;
3. the winners of the salts, at most `salts` rows for a text, are combined for the whole corpus.

In `exact_groups` a document then looks up its group by (digest, second hash, length, salt): a lookup, not a combining
stage, as spread as step 2. `deduplicated` first counts hashes of texts (8 bytes each) and marks those that occur twice in
a bit map of fixed size; only marked rows go through the steps above, which carry the winner's row along, and all other
rows stay where they are. No text is collected, and no list of ids is built.

Defined cases: a NULL id never wins against another id (all rows of a group stay when every id is NULL); rows that
repeat the winner's id are all marked as kept, and `deduplicated` returns one of them, always the same; an empty table
gives no rows; two hashes on one bit only cost work; other columns of the input never clash with the operator's own, for they travel in a struct or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.marks import marks_of, with_mark
from quantloom.llm.text import one_spaced, packed

SALTS = 64


def _keyed(docs: DataFrame, salts: int) -> DataFrame:
    body = one_spaced(F.col("text"))
    return docs.select(F.col("doc_id"), body.alias("body")).select(
        "doc_id",
        "body",
        F.sha2("body", 256).alias("text_sha256"),
        F.xxhash64("body").alias("second"),
        F.length("body").alias("length"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, salts)
    merged = keyed.groupBy("text_sha256", "salt", "body").agg(
        F.min("doc_id").alias("winner"),
        F.count("*").alias("n"),
        F.first("second").alias("second"),
        F.first("length").alias("length"),
    )
    same_text = Window.partitionBy("text_sha256", "body")
    combined = merged.select(
        "text_sha256",
        "second",
        "length",
        "salt",
        F.min("winner").over(same_text).alias("keep_id"),
        F.sum("n").over(same_text).alias("group_size"),
    )
    key = ["text_sha256", "second", "length", "salt"]
    return (
        keyed.select("doc_id", *key)
        .join(combined, key)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def _hash(text: Column) -> Column:
    return F.xxhash64(one_spaced(text))


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one per text, that with the smallest id."""
    counted = docs.groupBy(_hash(F.col("text")).alias("hashed")).agg(F.count("*").alias("n"))
    marks = marks_of(counted.where("n > 1"), "hashed")
    met = with_mark(docs.select(packed(docs.columns, "row")), _hash(F.col("row.text")), marks)
    single = met.where(~F.col("marked")).select("row.*")

    body = one_spaced(F.col("row.text"))
    same = F.coalesce(F.col("row.text") == F.col("body"), F.lit(False))
    # The text travels once where it is its own normal form.
    rest = F.struct(*[(F.when(~same, F.col("row.text")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    first = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("row").alias("tie"))
    candidates = (
        met.where("marked")
        .select("row", body.alias("body"))
        .select("body", F.sha2("body", 256).alias("digest"), F.pmod(F.xxhash64("row.doc_id"), F.lit(salts)).alias("salt"), first.alias("first"), F.struct(rest.alias("rest"), same.alias("same")).alias("kept"))
    )
    winner = lambda df, *key: df.groupBy("digest", *key, "body").agg(F.min_by("kept", "first").alias("kept"), F.min("first").alias("first"))
    whole = winner(winner(candidates, "salt"))
    columns = [(F.when(F.col("kept.same"), F.col("body")).otherwise(F.col("kept.rest.text")) if c == "text" else F.col(f"kept.rest.`{c}`")).alias(c) for c in docs.columns]
    return single.unionByName(whole.select(*columns))
