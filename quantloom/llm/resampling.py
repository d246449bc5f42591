"""Importance resampling towards a target distribution.

1. *Counts.* Every feature (a run of 1 to `longest` words) falls into one of `buckets` by its CRC-32. Each task counts
   its own texts into an array; arrays are added up by bucket.
2. *Weights from an array.* A bucket's gain is 1000 times the log ratio of its smoothed shares in the target and in the
   corpus, rounded down; the array has a fixed length, so it is broadcast whatever the corpus is. A document's weight is
   the sum of its features' gains, its score the weight plus Gumbel noise drawn from its id.
3. *Parallel sorting by regular sampling.* Rows of doc_id and numbers are sorted where they are (runs); every `step`-th
   row of a run is a sample, at most `SAMPLES` in all. The sorted samples give regular splitters by (score, doc_id), so
   ties of scores are split too. Rows are exchanged by segment, merged inside it, and a prefix sum of the segments'
   counts turns places into exact ranks. Segments behind the last drawn rank are never exchanged.

The driver sees `buckets` gains, at most `SAMPLES` samples and one count for each segment. Texts are never shuffled.

Defined cases: NULL, empty and wordless texts have no features and weight 0, and are not drawn while `least_words` is
above 0; a NULL id draws its noise from the text `null` and comes last among equal scores; rows that repeat an id
share its noise and take consecutive ranks, in the order of n_features and weight; very long texts are read piece by
piece and long words hashed whole; an empty target gives each bucket the same share; an empty table gives no rows;
extra columns are ignored here and kept by `resampled`.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.plainwords import texts_of, words
from quantloom.llm.text import packed
from quantloom.storage import materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
#: Samples of all runs together at most, and rows of a segment to aim at.
SAMPLES, SEGMENT_ROWS = 1 << 16, 1 << 16
#: Samples for each segment at least: they keep segments even.
SAMPLES_EACH = 16
_LAST = np.iinfo(np.int64).max


def feature_buckets(text: bytes, buckets: int, longest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end there) for each piece of the text."""
    before: deque[bytes] = deque(maxlen=max(longest - 1, 1))
    for part in words(text):
        found = [np.fromiter(map(crc32, part), np.uint32, len(part))]
        if longest > 1:
            line = [*before, *part] if before else part
            fresh = len(line) - len(part)
            runs = [
                crc32(b" ".join(line[end - n : end]))
                for n in range(2, longest + 1)
                for end in range(max(n, fresh + 1), len(line) + 1)
            ]
            found.append(np.array(runs, np.uint32))
            before.extend(part)
        yield len(part), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(bucket, n): features of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                for _, found in feature_buckets(text, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """For each bucket floor(1000 ln(share in the target / share in the documents)), both smoothed by 1."""
    both = (
        docs.sparkSession.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target, buckets, longest).withColumnRenamed("n", "t"), "bucket", "left")
        .na.fill(0, ["s", "t"])
        .collect()  # `buckets` rows
    )
    gains = np.zeros(buckets, np.int64)
    s = np.zeros(buckets)
    t = np.zeros(buckets)
    for row in both:
        s[row.bucket], t[row.bucket] = row.s, row.t
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    gains[:] = np.floor(1000 * np.log(ratio))
    return gains


def _noise(seed: str, doc_id: Column) -> Column:
    """Gumbel noise of a document, in thousandths rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_scores(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, seed: str = "2024"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row of `docs` (doc_id, text)."""
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, buckets, longest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gains.value
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(texts_of(batch)):
                for n, found in feature_buckets(text, buckets, longest):
                    made[:, i] += n, len(found), value[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, made)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + _noise(seed, F.col("doc_id")))


def regular_splitters(rows: DataFrame, n_rows: int, segments: int, samples: int = SAMPLES) -> np.ndarray:
    """At most segments - 1 regular splitters (score, doc_id), from every step-th row of each sorted run."""
    step = max(1, -(-n_rows // samples))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = step // 2  # rows of the run before this batch, half a step ahead
        for batch in batches:
            yield batch.take(pa.array(np.arange(-at % step, batch.num_rows, step)))
            at += batch.num_rows

    run = rows.select("score", F.col("doc_id").cast("long").alias("doc_id")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = run.mapInArrow(pick, "score long, doc_id long").collect()  # at most `samples` rows
    keys = np.array([(r.score, _LAST if r.doc_id is None else r.doc_id) for r in found], np.int64).reshape(-1, 2)
    keys = keys[np.lexsort((keys[:, 1], -keys[:, 0]))]
    places = np.arange(1, segments) * len(keys) // segments
    return np.unique(keys[places], axis=0) if len(keys) else keys


def in_segments(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Add `segment`: splitters at or before the row in the order of falling scores and rising ids."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            score = batch.column("score").to_numpy()
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
            is_row = np.r_[np.zeros(len(cuts), np.int8), np.ones(len(score), np.int8)]
            order = np.lexsort((is_row, np.r_[cuts[:, 1], ids], -np.r_[cuts[:, 0], score]))
            passed = np.empty(len(order), np.int64)
            passed[order] = np.cumsum(1 - is_row[order])
            yield batch.append_column("segment", pa.array(passed[len(cuts) :]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{schema}, segment long")


def ranked(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = BUCKETS,
    longest: int = 1,
    seed: str = "2024",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of `docs`; rank is NULL for what is not drawn.

    Of the rows with `least_words` words `percent` in a hundred are drawn, those with the highest scores.
    """
    stored = materialise(importance_scores(docs, target, buckets, longest, seed), "scores")
    able = F.col("n_words") >= least_words
    candidates = stored.where(able)
    n_rows = candidates.count()
    drawn = percent * n_rows // 100
    segments = max(1, min(-(-n_rows // segment_rows), SAMPLES // SAMPLES_EACH))
    placed = in_segments(candidates, regular_splitters(candidates, n_rows, segments))
    sizes = placed.groupBy("segment").count().collect() if drawn else []  # one row for each segment
    offsets, before = [], 0
    for segment, n in sorted(map(tuple, sizes)):
        if before >= drawn:
            break
        offsets.append((segment, before))
        before += n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not offsets:
        return stored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = offsets[-1][0]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*order)) + F.col("before")
    table = docs.sparkSession.createDataFrame(offsets, "segment long, before long")
    ahead = (
        placed.where(F.col("segment") <= last)
        .join(F.broadcast(table), "segment")
        .select(*columns, place.cast("long").alias("place"))
        .select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    )
    behind = placed.where(F.col("segment") > last).unionByName(stored.where(~able).withColumn("segment", F.lit(None).cast("long")))
    return ahead.unionByName(behind.select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` with a drawn id, with all their columns; rows that repeat an id come together."""
    keys = ranked(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    rows = docs.select(packed(docs.columns, "row"), F.col("doc_id").alias("row_id"))
    return rows.join(keys, F.col("row_id").eqNullSafe(F.col("drawn_id")), "left_semi").select("row.*")
