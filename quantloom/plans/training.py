"""Training rows of the classifier, and the sequence samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import fundamentals as fund
from quantloom.operators import sequences as seq
from quantloom.operators import series
from quantloom.sources.readers import EXCLUDED_NAMES, TRAIN_DAYS, days_before, in_range, tradable

# The model's features, in order.
FEATURES = ["ret_20", "ret_60", "vol_20", "per", "pbr", "roe", "rsi_14", "macd", "macd_hist", "macd_signal"]
LABEL = "target"


def statement_years(as_of: dt.date) -> list[int]:
    return list(range(as_of.year - fund.STATEMENT_YEARS, as_of.year))


def feature_history(
    listing: DataFrame,
    code_map: DataFrame,
    bars: DataFrame,
    statements: DataFrame,
    as_of: dt.date,
    excluded: str = EXCLUDED_NAMES,
    lag_years: int = 0,
    one_bar_a_day: bool = False,
) -> DataFrame:
    """Every bar of the last three years with its features, ratios and label.

    Instruments without a mapped code, without statements or with a short history are left out. Their amounts are joined
    to each segment of a ticker, so that a long one is spread over tasks from the start.
    """
    window = in_range(bars, days_before(as_of, TRAIN_DAYS), as_of).select("ticker", "date", "close", "volume")
    filled = fund.filled_amounts(window, statements, statement_years(as_of), lag_years)
    universe = (
        fund.with_mapped_code(tradable(listing, excluded), code_map)
        .select("ticker", "shares")
        .join(fund.amounts_by_segment(filled), "ticker")
    )
    joined = fund.with_amounts(fund.join_by_segment(window, universe))
    longest = TRAIN_DAYS + 1 if one_bar_a_day else None
    featured = series.featured(joined, [*series.PRICE_FEATURES, LABEL], longest, series.TRAIN_MIN_ROWS)
    return fund.finite_columns(fund.with_history_ratios(featured.drop("_segment")), FEATURES)


def training_rows(history: DataFrame) -> DataFrame:
    """(ticker, date, features, target) of the bars where every feature is known."""
    return history.dropna(subset=FEATURES).select("ticker", "date", *FEATURES, LABEL)


def sequence_samples(bars: DataFrame, tickers: DataFrame | None, as_of: dt.date) -> DataFrame:
    """Labelled sequences of the last three years, of the given tickers (all without)."""
    return seq.labelled(sequences(bars, tickers, as_of))


def sequences(bars: DataFrame, tickers: DataFrame | None, as_of: dt.date) -> DataFrame:
    window = in_range(bars, days_before(as_of, TRAIN_DAYS), as_of).select("ticker", "date", "close")
    if tickers is not None:
        window = window.join(tickers.select("ticker"), "ticker", "left_semi")
    return seq.sequences(window)
