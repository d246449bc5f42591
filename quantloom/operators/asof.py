"""As-of join: each row with the last row of another table that was known by then.

Both tables go into one stream per ticker, sorted by time; the last known row is carried along it. The stream is cut into
calendar segments, and what is known before a segment arrives as one summary row, so that a ticker with very many rows is
spread over tasks, and no pair of rows that don't belong together is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import segments as seg


def asof_join(
    rows: DataFrame, known: DataFrame, since: str, values: Sequence[str], segment_days: int = seg.SEGMENT_DAYS
) -> DataFrame:
    """`rows` (ticker, date, ..) with `values` of the last row of `known` (ticker, `since`, values..) with since <= date.

    NULL where nothing was known yet. (ticker, since) should be unique in `known`; rows of it without a date are never known.
    A date shared by both counts as known.
    """
    nothing = F.lit(None).cast(known.select(F.struct(*values).alias("v")).schema["v"].dataType)
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    stream = rows.select("ticker", "date", F.lit(1).alias("_side"), carried.alias("_row"), nothing.alias("_value")).unionByName(
        known.where(F.col(since).isNotNull()).select(
            "ticker",
            F.col(since).cast(rows.schema["date"].dataType).alias("date"),
            F.lit(0).alias("_side"),
            F.lit(None).cast(rows.select(carried.alias("r")).schema["r"].dataType).alias("_row"),
            F.struct(*values).alias("_value"),
        )
    )
    cut = seg.cut(stream, segment_days)
    here = Window.partitionBy(*seg.SEGMENT).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max_by("_value", F.when(F.col("_side") == 0, F.col("date")))
    summary = cut.groupBy(*seg.SEGMENT).agg(latest.alias("_last"))
    summary = summary.select(*seg.SEGMENT, F.last("_last", ignorenulls=True).over(seg.earlier()).alias("_before"))
    own = cut.withColumn("_here", F.last("_value", ignorenulls=True).over(here)).where("_side = 1")
    met = seg.with_summary(own, summary).withColumn("_known", F.coalesce("_here", "_before"))
    return met.select("_row.*", *[F.col(f"_known.{v}").alias(v) for v in values])
