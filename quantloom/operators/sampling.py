"""Stratified split and minority over-sampling, repeatable from hashes of the row keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import unit_draw
from quantloom.operators.neighbours import nearest
from quantloom.operators.order import row_positions
from quantloom.storage import materialise

# Held-out share, seed and neighbours per sample.
TEST_SHARE = 0.3
SEED = 42
NEIGHBOURS = 5
# Synthetic rows made by one generator row; a vector that needs more is spread over several.
_CHUNK = 10_000


def stratified_split(
    rows: DataFrame,
    key: Sequence[str],
    label: str = "target",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add `is_test`: exactly round(share * n) rows of every class, in the order of a key hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    placed = row_positions(rows.withColumn("_digest", digest), [label, "_digest", *key], "_position")
    classes = {r[label]: r["rows"] for r in placed.groupBy(label).agg(F.count("*").alias("rows")).collect()}
    is_test: Column = F.lit(None).cast("boolean")
    before = 0
    for value in sorted(classes):
        wanted = int(np.floor(test_share * classes[value] + 0.5))
        is_test = F.when(F.col(label) == value, F.col("_position") - before <= wanted).otherwise(is_test)
        before += classes[value]
    return placed.withColumn("is_test", is_test).drop("_digest", "_position")


def time_split(rows: DataFrame, label: str = "target", test_share: float = TEST_SHARE) -> DataFrame:
    """Add `is_test` for the last dates holding about `test_share` of the rows (no overlapping windows)."""
    days = sorted((r["date"], r["rows"]) for r in rows.groupBy("date").agg(F.count("*").alias("rows")).collect())
    total, seen, first = sum(n for _, n in days), 0, None
    for day, n in reversed(days):
        if first is not None and seen >= test_share * total:
            break
        seen, first = seen + n, day
    return rows.withColumn("is_test", F.col("date") >= F.lit(first))


def time_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Add `_fold` (0..): stretches of dates in order, with about equally many rows each."""
    days = sorted((r["date"], r["rows"]) for r in rows.groupBy("date").agg(F.count("*").alias("rows")).collect())
    total, seen, bounds = sum(n for _, n in days), 0, []
    for day, n in days:  # one number for each date
        while len(bounds) < folds - 1 and seen >= total * (len(bounds) + 1) / folds:
            bounds.append(day)
        seen += n
    fold = sum([(F.col("date") >= F.lit(day)).cast("int") for day in bounds], F.lit(0))
    return rows.withColumn("_fold", fold)


# Days of a bucket: the intervals of a label window or of held-out dates meet a few of them.
_BUCKET_DAYS = 32


def _buckets(first: Column, last: Column) -> Column:
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / _BUCKET_DAYS)
    return F.sequence(number(first), number(last))


def purged_folds(
    rows: DataFrame, key: Sequence[str], fold: str = "_fold", end: str = "target_end", embargo_days: int = 0
) -> DataFrame:
    """(fold, key.., part): for each fold every row as `test`, `train` or `purged`.

    A training row is purged when its label window [date, `end`] overlaps that of a held-out row, or when it begins within
    `embargo_days` behind one: its label would tell of held-out prices. Held-out windows of a fold are merged by their first
    date (one row for each date, with the latest end), both sides go into date buckets, and only rows and windows of one
    bucket are compared. `key` should be unique.
    """
    held = rows.groupBy(F.col(fold).alias("fold"), F.col("date").alias("from")).agg(F.date_add(F.max(end), embargo_days).alias("to"))
    held = materialise(held, "held-out")
    folds = held.select("fold").distinct()
    spread = held.withColumn("bucket", F.explode(_buckets(F.col("from"), F.col("to"))))
    windows = spread.groupBy("fold", "bucket").agg(F.collect_list(F.struct("from", "to")).alias("windows"))  # a bucket's dates at most, and earlier ones that reach it
    own = rows.select(*key, F.col("date").alias("begin"), F.col(end).alias("finish"), F.col(fold).alias("own"))
    touched = own.withColumn("bucket", F.explode(_buckets(F.col("begin"), F.col("finish")))).join(windows, "bucket")
    overlaps = F.exists("windows", lambda w: (F.col("begin") <= w["to"]) & (w["from"] <= F.col("finish")))
    hit = touched.where((F.col("own") != F.col("fold")) & overlaps).select("fold", *key).distinct()
    all_rows = own.crossJoin(F.broadcast(folds)).withColumn("is_test", F.col("own") == F.col("fold"))
    met = all_rows.join(hit.withColumn("is_hit", F.lit(True)), ["fold", *key], "left")
    part = F.when(F.col("is_test"), "test").when(F.col("is_hit"), "purged").otherwise("train")
    return met.select("fold", *key, part.alias("part"))


def class_counts(rows: DataFrame, label: str = "target") -> dict[int, int]:
    return {r[label]: r["rows"] for r in rows.groupBy(label).agg(F.count("*").alias("rows")).collect()}


def smote(
    rows: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    label: str = "target",
    neighbours: int = NEIGHBOURS,
    seed: int = SEED,
) -> DataFrame:
    """(features.., label, synthetic): all rows plus synthetic minority rows until the classes are equal.

    A synthetic row lies between a minority row and one of its exact nearest minority neighbours.
    Rows with equal features are handled as one vector with a count: they are each other's nearest
    neighbours, and no group of copies is compared with itself. The wanted number of synthetic rows
    is spread evenly over the minority rows.
    """
    counts = class_counts(rows, label)
    original = rows.select(*features, label, F.lit(False).alias("synthetic"))
    if len(counts) != 2 or len(set(counts.values())) == 1:
        return original
    minor, major = sorted(counts, key=lambda c: counts[c])
    have, need = counts[minor], counts[major] - counts[minor]

    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    minority = rows.where(F.col(label) == minor).withColumn("_digest", digest)
    placed = row_positions(minority, ["_digest", *key], "_position")
    share = (F.col("_position").cast("decimal(38,0)") * need / have).cast("long") - (
        (F.col("_position") - 1).cast("decimal(38,0)") * need / have
    ).cast("long")
    values = F.array(*[F.col(f).cast("double") for f in features])
    vectors = (
        placed.groupBy(*features)
        .agg(F.min("_position").alias("id"), F.count("*").alias("copies"), F.sum(share).alias("make"))
        .select("id", values.alias("x"), "copies", "make")
    )
    vectors = materialise(vectors, "minority")
    found = nearest(vectors, neighbours)

    limit = F.lit(neighbours)
    own = F.array_repeat("id", F.least(F.col("copies") - 1, limit).cast("int"))
    others = F.flatten(
        F.transform("near", lambda n: F.array_repeat(n["near_id"], F.least(n["near_copies"], limit).cast("int")))
    )
    choices = F.slice(F.concat(own, others), 1, neighbours)
    chunks = (
        found.where(F.col("make") > 0)
        .select("id", "x", "make", F.when(F.size(choices) > 0, choices).otherwise(F.array("id")).alias("choices"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("make") - 1) / _CHUNK))))
        .repartition("id", "chunk")
    )
    last = F.least(F.col("make"), (F.col("chunk") + 1) * _CHUNK)
    drawn = chunks.withColumn("draw", F.explode(F.sequence(F.col("chunk") * _CHUNK + 1, last)))
    pick = F.floor(unit_draw(F.lit(seed), F.col("id"), F.col("draw")) * F.size("choices")).cast("int")
    step = unit_draw(F.lit(seed + 1), F.col("id"), F.col("draw"))
    partners = vectors.select(F.col("id").alias("partner"), F.col("x").alias("y"))
    synthetic = (
        drawn.select("x", F.get("choices", pick).alias("partner"), step.alias("u"))
        .join(partners, "partner")
        .select(
            *[(F.col("x")[i] + F.col("u") * (F.col("y")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)],
            F.lit(minor).cast("int").alias(label),
            F.lit(True).alias("synthetic"),
        )
    )
    return original.unionByName(synthetic)


def class_weights(rows: DataFrame, label: str = "target") -> DataFrame:
    """Add `weight` so that both classes weigh the same: the cheap alternative to over-sampling."""
    counts = class_counts(rows, label)
    weight: Column = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return rows.withColumn("weight", weight)
