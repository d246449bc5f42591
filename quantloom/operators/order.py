"""Exact ranks, running totals and row numbers over one large cross-section, without a single-task window.

Everything here is one path for every size. Ranks, medians and areas are taken from the distinct values: equal values are
counted before the shuffle, so a value shared by a third of all rows is one row, and only distinct values are sorted,
by a range partitioning with one offset per partition. `row_positions` numbers rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.storage import materialise

# monotonically_increasing_id keeps the row index inside a partition in its low 33 bits.
_ROW_BITS = 33


def running_totals(df: DataFrame, by: str, order: str, values: Sequence[str]) -> DataFrame:
    """Add `<v>_before` for each of `values`: its sum over the rows of the same `by` with a smaller `order`.

    (by, order) must be unique. Rows are range-partitioned and sorted; a window never holds more than one of these
    partitions, and the offsets are one row per partition and `by`.
    """
    tagged = df.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(tagged, "totals").withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int")).drop("_at")
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(by, "_part")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(by, "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    )
    inside = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
        .join(offsets, [by, "_part"])
        .withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values})
        .drop("_part", *[f"_{v}" for v in values])
    )


def _long(df: DataFrame, carry: Sequence[str], columns: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*carry, F.explode(F.array(*items)).alias("item")).select(*carry, "item.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, value, rows, rows_before): every distinct non-missing value of each column."""
    counted = _long(df, [], columns).where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count("*").alias("rows"))
    return running_totals(counted, "metric", "value", ["rows"])


def ranked_long(df: DataFrame, carry: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(carry.., metric, value, rank) with one row per input row and column.

    rank = 1 + number of smaller values of the same column, NULL for a missing value. The join back to the rows has one
    row for each value on its other side, so adaptive execution may split the rows of a frequent value.
    """
    ranks = value_counts(df, columns).select("metric", "value", (F.col("rows_before") + 1).alias("rank"))
    return _long(df, carry, columns).join(ranks, ["metric", "value"], "left").select(*carry, "metric", "value", "rank")


def counts_of(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Rows (`"*"`) and non-missing values per column, in one pass."""
    row = df.agg(F.count("*").alias("*"), *[F.count(c).alias(c) for c in columns]).first()
    return row.asDict()


def min_ranks(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    counts: dict[str, int] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key.., carry.., <c>_rank, <c>_n for each column): minimum ranks, NULL for missing values.

    `key` must be unique and `df` should be cheap to read again: it is scanned for the counts, for the values and for
    the ranks. `<c>_n` is the number of non-missing values.
    """
    if counts is None:
        counts = counts_of(df, columns)
    ranked = ranked_long(df, [*key, *carry], columns)
    if len(columns) == 1:
        wide = ranked.select(*key, *carry, F.col("rank").alias(f"{columns[0]}_rank"))
    else:
        wide = ranked.groupBy(*key).agg(
            *[F.max(c).alias(c) for c in carry],
            *[F.max(F.when(F.col("metric") == c, F.col("rank"))).alias(f"{c}_rank") for c in columns],
        )
    return wide.select("*", *[F.lit(counts[c]).cast("long").alias(f"{c}_n") for c in columns])


def pct_rank(column: str) -> Column:
    """Rank divided by the number of non-missing values; missing stays missing."""
    return F.try_divide(F.col(f"{column}_rank"), F.col(f"{column}_n"))


def rank_nulls_last(column: str) -> Column:
    """Minimum rank when missing values share the position after all others."""
    return F.coalesce(F.col(f"{column}_rank"), F.col(f"{column}_n") + 1)


def row_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the exact row number (1..n) in the given order.

    The order should be total (end it with a unique key). Rows are range-partitioned, sorted and
    written with their index inside the partition; only one count per partition is read back, and
    the offsets are joined as a table of that size.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stored = materialise(tagged, "positions").withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int"))
    sizes = sorted((r["_part"], r["rows"]) for r in stored.groupBy("_part").agg(F.count("*").alias("rows")).collect())
    offsets, total = [], 0
    for part, rows in sizes:  # one number for each partition
        offsets.append((part, total))
        total += rows
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    index = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_before") + index + 1)
        .drop("_part", "_at", "_before")
    )
