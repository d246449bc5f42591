"""Exact column medians and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.order import value_counts


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolated median per column; None for a column without values.

    One pass over all columns: distinct values with running counts, of which the one or two middle ones are picked.
    """
    values = value_counts(df, columns)
    whole = values.groupBy("metric").agg(F.sum("rows").alias("n"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = lambda place: (F.col("rows_before") <= place) & (place < F.col("rows_before") + F.col("rows"))
    middle = (
        values.join(F.broadcast(whole), "metric")  # one row for each column
        .groupBy("metric")
        .agg(F.max(F.when(holds(low), F.col("value"))).alias("low"), F.max(F.when(holds(high), F.col("value"))).alias("high"))
    )
    found = {r.metric: r.low if r.low == r.high else (r.low + r.high) / 2 for r in middle.collect()}
    return {c: found.get(c) for c in columns}


def impute(df: DataFrame, columns: Sequence[str], middle: dict[str, float | None]) -> DataFrame:
    """Missing numbers become the column's median, or 0 where there is none; missing text becomes '0'."""
    numbers = {c: F.coalesce(F.col(c), F.lit(middle[c]).cast("double"), F.lit(0.0)) for c in columns}
    texts = {
        f.name: F.coalesce(F.col(f.name), F.lit("0"))
        for f in df.schema.fields
        if f.dataType.typeName() == "string" and f.name not in columns
    }
    return df.withColumns({**numbers, **texts})
