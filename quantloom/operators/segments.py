"""Series of any length in segments, on one path: what lies before or behind a segment arrives as one summary row.

A segment is a ticker's rows of one stretch of the calendar, so it is known from the row itself: no counting, no row
numbers, and one exchange by (ticker, segment) carries every window. A ticker that holds a third of all rows is spread
over its segments. Summaries (one row for each segment or block) are scanned per ticker: lengths by running sums, values
around a segment by short arrays, recursions by composing affine maps.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Days of a segment. More rows a day make longer segments, never wrong ones.
SEGMENT_DAYS = 2_048
SEGMENT = ("ticker", "_segment")


def segment_of(date: Column, days: int = SEGMENT_DAYS) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / days)


def cut(bars: DataFrame, days: int = SEGMENT_DAYS) -> DataFrame:
    """Add `_segment` where it isn't there; `date` is a date or a timestamp and orders the rows of a ticker."""
    return bars if "_segment" in bars.columns else bars.withColumn("_segment", segment_of(F.col("date"), days))


def in_segment() -> WindowSpec:
    return Window.partitionBy(*SEGMENT).orderBy("date")


def to_here() -> WindowSpec:
    return in_segment().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(rows: DataFrame) -> DataFrame:
    """Add `_local`, the row's number in its segment (from 0), and `_n`, the segment's rows."""
    whole = in_segment().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"_local": (F.row_number().over(in_segment()) - 1).cast("long"), "_n": F.count("*").over(whole)})


def first_rows(value: Column, rows: int) -> Column:
    """Aggregate: the value in the first rows of a segment, in order."""
    return _ordered(value, F.col("_local") < rows)


def last_rows(value: Column, rows: int) -> Column:
    """Aggregate: the value in the last rows of a segment, in order."""
    return _ordered(value, F.col("_local") >= F.col("_n") - rows)


def _ordered(value: Column, chosen: Column) -> Column:
    kept = F.collect_list(F.when(chosen, F.struct(F.col("_local").alias("at"), value.alias("value"))))
    return F.transform(F.sort_array(kept), lambda x: x["value"])


def _order() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("_segment")


def earlier() -> WindowSpec:
    """All segments of the ticker before this one, in a frame of summary rows."""
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def values_before(tails: str, rows: int) -> Column:
    """The last `rows` values before a segment, from the tails of segments that have a row at least."""
    found = F.flatten(F.collect_list(tails).over(_order().rowsBetween(-rows, -1)))
    return F.slice(found, F.greatest(F.size(found) - (rows - 1), F.lit(1)), rows)


def values_after(heads: str, rows: int) -> Column:
    """The first `rows` values behind a segment."""
    return F.slice(F.flatten(F.collect_list(heads).over(_order().rowsBetween(1, rows))), 1, rows)


def before_row(values: Column, back: Column) -> Column:
    """The value `back` rows before the segment's first row (1 is the row right before), NULL beyond the series."""
    return F.try_element_at(values, (-back).cast("int"))


def last_of(values: Column, n: Column) -> Column:
    """The last n values (all, if there are fewer)."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


def with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows with what their segment's summary row says: only the summary is exchanged for the join."""
    return rows.join(summary.hint("shuffle_hash"), list(SEGMENT))


def rounds_for(blocks: int) -> int:
    """Doubling rounds that reach over so many blocks."""
    return max(1, (max(blocks, 1) - 1).bit_length())


def composed(
    blocks: DataFrame, compose: Callable[[Mapping[str, Column], Mapping[str, Column]], Mapping[str, Column]], maps: list[str], rounds: int
) -> DataFrame:
    """Parallel scan: each block's map becomes that of all blocks of its ticker before it (NULLs for the first).

    Each round composes a block's map with that of the block 1, 2, 4, ... places before it, which by then covers as many
    blocks itself; `compose(earlier, later)` returns the columns of both in turn. All rounds share one exchange and sort.
    """
    order = Window.partitionBy("ticker").orderBy("_segment", "_block")
    number = F.row_number().over(order)
    bound = F.when(number <= 1 << rounds, number).otherwise(F.raise_error(F.lit("a series is longer than the bound given for it")))
    now = blocks.withColumn("_number", bound)
    for r in range(rounds):
        back = F.lag(F.struct(*maps), 1 << r).over(order)
        now = now.withColumn("_back", back)
        both = compose({m: F.col(f"_back.{m}") for m in maps}, {m: F.col(m) for m in maps})
        now = now.withColumns({m: F.when(F.col("_back").isNull(), F.col(m)).otherwise(both[m]) for m in maps})
    return now.withColumn("_back", F.when(F.col("_number").isNotNull(), F.lag(F.struct(*maps), 1).over(order))).select(
        *SEGMENT, "_block", "_back"
    )
