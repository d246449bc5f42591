"""Rank today's instruments: bars -> features -> valuation -> imputation -> scores -> blend -> rank."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import fundamentals as fund
from quantloom.operators import series
from quantloom.operators.blend import WEIGHTS, final_ranking, join_predictions
from quantloom.operators.impute import impute, medians
from quantloom.operators.scores import factor_scores
from quantloom.sources.readers import EXCLUDED_NAMES, SERVE_DAYS, days_before, in_range, tradable
from quantloom.storage import materialise

_MEASURES = [*series.PRICE_FEATURES, *fund.RATIOS]
# Everything numeric in the universe is imputed; the first three are never missing in practice.
_NUMERIC = ["last_close", "market_cap_eok", "volume", *_MEASURES]


def latest_features(bars: DataFrame, longest: int | None = None) -> DataFrame:
    """One row per ticker with enough bars: last date, close, volume and all price features."""
    featured = series.featured(bars, series.PRICE_FEATURES, longest, series.SERVE_MIN_ROWS)
    return series.latest(featured, ["close", "volume", *series.PRICE_FEATURES]).withColumnRenamed(
        "close", "last_close"
    )


def valued_universe(
    listing: DataFrame,
    code_map: DataFrame,
    bars: DataFrame,
    statements: DataFrame,
    as_of: dt.date,
    excluded: str = EXCLUDED_NAMES,
    one_bar_a_day: bool = False,
) -> DataFrame:
    """Latest features, market value and guarded ratios of every instrument with a statement row.

    `one_bar_a_day` states that (ticker, date) is unique, so the date range bounds every series and
    no count is needed.
    """
    window = in_range(bars, days_before(as_of, SERVE_DAYS), as_of)
    latest = latest_features(window, SERVE_DAYS + 1 if one_bar_a_day else None)
    filed = fund.pivot_statements(statements.where(F.col("year") == as_of.year - 1))
    instruments = fund.with_mapped_code(tradable(listing, excluded), code_map).join(filed, "ticker")
    valued = fund.with_latest_ratios(latest.join(instruments, "ticker"))
    columns = ["ticker", "name", "date", *_NUMERIC]
    return fund.finite_columns(valued.withColumn("volume", F.col("volume").cast("double")), _MEASURES).select(*columns)


def imputed_universe(valued: DataFrame) -> tuple[DataFrame, int]:
    """The stored universe without missing values, and its size.

    The universe (one row per instrument) is written once here: the medians, ranks and blend after
    it read that table instead of the bars.
    """
    stored = materialise(valued, "universe")
    return impute(stored, _NUMERIC, medians(stored, _NUMERIC)), stored.count()


def rank_universe(
    listing: DataFrame,
    code_map: DataFrame,
    bars: DataFrame,
    statements: DataFrame,
    as_of: dt.date,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    extra_scores: Mapping[str, DataFrame] | None = None,
    weights: Mapping[str, float] = WEIGHTS,
    excluded: str = EXCLUDED_NAMES,
    one_bar_a_day: bool = False,
) -> DataFrame:
    """All instruments with their scores, final score and final rank, in rank order.

    `predict` maps the imputed features to (ticker, ml_pred_proba); `extra_scores` are further
    (ticker, score) frames by name, for example sentiment_score or dl_trend_score.
    """
    valued = valued_universe(listing, code_map, bars, statements, as_of, excluded, one_bar_a_day)
    universe, rows = imputed_universe(valued)
    scored = factor_scores(universe, rows)
    if predict is not None:
        scored = join_predictions(scored, predict(universe))
    for name, frame in (extra_scores or {}).items():
        scored = join_predictions(scored, frame.select("ticker", name))
    return final_ranking(scored, weights)
