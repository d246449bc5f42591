"""Annual statements: parse, pivot, fill over years, and join to bars or instruments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import WON_PER_EOK, finite, market_cap, parse_amount, ratio, ratio_if_positive
from quantloom.operators import segments as seg
from quantloom.operators.asof import asof_join

ACCOUNTS = ["net_income", "total_equity"]
RATIOS = ["per", "pbr", "roe"]
# Fixed value: training reads the statements of this many years before the current one.
STATEMENT_YEARS = 4


def pivot_statements(statements: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """One row per key with the wanted accounts; duplicates of an account are averaged.

    Other accounts are dropped first, so that they cannot keep a key alive, and so are keys without
    any number. One conditional average per account pivots in a single pre-aggregated shuffle.
    """
    amount = parse_amount(F.col("amount_raw"))
    return (
        statements.where(F.col("account").isin(ACCOUNTS))
        .groupBy(*keys)
        .agg(*[F.avg(F.when(F.col("account") == a, amount)).alias(a) for a in ACCOUNTS])
        .dropna(how="all", subset=ACCOUNTS)
    )


def fill_by_year(bar_years: DataFrame, yearly: DataFrame) -> DataFrame:
    """(ticker, year, accounts) for each year with bars: last known year first, else the next one.

    All bars of a ticker and year share their amounts, so filling the handful of years of a ticker
    equals filling its bars one by one, without a pass over the bars.
    """
    by = Window.partitionBy("ticker").orderBy("year")
    back = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = bar_years.join(yearly, ["ticker", "year"], "left")
    return joined.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))
            for c in ACCOUNTS
        }
    )


def filled_amounts(bars: DataFrame, statements: DataFrame, years: Sequence[int], lag_years: int = 0) -> DataFrame:
    """(ticker, year, accounts) filled over the years with bars; tickers without an account are dropped.

    `lag_years=1` uses the statement of the year before, which was public by then; the default uses
    the same calendar year.
    """
    yearly = pivot_statements(statements.where(F.col("year").isin(list(years))), ["ticker", "year"])
    if lag_years:
        yearly = yearly.withColumn("year", F.col("year") + lag_years)
    bar_years = bars.select("ticker", F.year("date").alias("year")).distinct()
    return fill_by_year(bar_years, yearly).dropna(subset=ACCOUNTS)


def amounts_by_segment(filled: DataFrame) -> DataFrame:
    """(ticker, _segment, amounts): for each calendar segment of a ticker the filled years that it meets, as a small map."""
    ends = [seg.segment_of(F.make_date("year", F.lit(month), F.lit(day))) for month, day in ((1, 1), (12, 31))]
    entry = F.struct("year", F.struct(*ACCOUNTS))
    met = filled.withColumn("_segment", F.explode(F.sequence(*ends)))
    return met.groupBy(*seg.SEGMENT).agg(F.map_from_entries(F.collect_list(entry)).alias("amounts"))


def join_by_segment(bars: DataFrame, instruments: DataFrame) -> DataFrame:
    """Bars with the columns of their instrument, which has a row for each of its segments; partitioned by segment.

    A shuffled hash join with the instruments as the built side: the bars are exchanged once for the join and all windows
    after it, and a ticker with very many bars is spread over its segments.
    """
    return seg.with_summary(seg.cut(bars), instruments)


def with_amounts(df: DataFrame) -> DataFrame:
    """Replace `amounts` by the accounts of the row's calendar year."""
    found = F.element_at("amounts", F.year("date"))
    return df.withColumns({c: found[c] for c in ACCOUNTS}).drop("amounts")


def with_fundamentals(bars: DataFrame, filled: DataFrame) -> DataFrame:
    """Bars with the filled amounts of their calendar year."""
    return with_amounts(join_by_segment(bars, amounts_by_segment(filled))).drop("_segment")


def with_published(bars: DataFrame, yearly: DataFrame) -> DataFrame:
    """Bars with the amounts of the last statement published by their date: `yearly` is (ticker, published, accounts).

    The point-in-time form of `with_fundamentals`: it never looks ahead, and nothing is filled backwards.
    """
    return asof_join(bars, yearly, "published", ACCOUNTS)


def with_history_ratios(df: DataFrame) -> DataFrame:
    """Training ratios: losses stay negative, a zero denominator is missing."""
    return df.withColumn("market_cap", market_cap(F.col("close"), F.col("shares"))).withColumns(
        {
            "per": ratio(F.col("market_cap"), F.col("net_income")),
            "pbr": ratio(F.col("market_cap"), F.col("total_equity")),
            "roe": ratio(F.col("net_income"), F.col("total_equity")),
        }
    )


def with_latest_ratios(df: DataFrame) -> DataFrame:
    """Serving ratios: only positive denominators count; market value in units of 1e8."""
    value = market_cap(F.col("last_close"), F.col("shares"))
    return df.withColumns(
        {
            "per": ratio_if_positive(value, F.col("net_income")),
            "pbr": ratio_if_positive(value, F.col("total_equity")),
            "roe": ratio_if_positive(F.col("net_income"), F.col("total_equity")),
            "market_cap_eok": value / WON_PER_EOK,
        }
    )


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def with_mapped_code(listing: DataFrame, code_map: DataFrame) -> DataFrame:
    """Instruments that have a filing code; a repeated code repeats nothing."""
    return listing.join(code_map.select("ticker"), "ticker", "left_semi")


def mapped_universe(listing: DataFrame, code_map: DataFrame) -> DataFrame:
    """Instruments whose statements can be requested."""
    return listing.join(code_map, "ticker")


def distinct_codes(universe: DataFrame) -> DataFrame:
    return universe.select("corp_code").distinct()
