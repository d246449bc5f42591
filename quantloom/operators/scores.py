"""Factor scores 0..100 from cross-sectional ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import inverse_or_floor, round_half_even
from quantloom.operators.order import min_ranks, pct_rank, rank_nulls_last
from quantloom.storage import materialise

SCORES = ["value_score", "quality_score", "momentum_score", "supply_score", "volatility_score"]
_BASE = ["ticker", "name"]
_OPTIONAL = ["last_close", "market_cap_eok"]
_RANKED = ["inv_per", "inv_pbr", "roe", "ret_20", "ret_60", "vol_20"]


def _score(rank: Column, rows: int) -> Column:
    return rank / F.lit(float(rows)) * 100


def raw_factor_scores(universe: DataFrame, rows: int, low_is_good: bool = False) -> DataFrame:
    """(ticker, five unrounded scores) of `universe`, which is scanned a few times and has `rows` rows.

    Missing measures take the position after all others, so they score best. Volatility scores high
    when it is high; `low_is_good` turns that around. Sums of ranks are ranked as whole numbers.
    """
    measures = universe.select(
        "ticker",
        inverse_or_floor(F.col("per")).alias("inv_per"),
        inverse_or_floor(F.col("pbr")).alias("inv_pbr"),
        "roe",
        "ret_20",
        "ret_60",
        (-F.col("vol_20") if low_is_good else F.col("vol_20")).alias("vol_20"),
    )
    first = min_ranks(measures, ["ticker"], _RANKED).select(
        "ticker",
        (F.col("inv_per_rank") + F.col("inv_pbr_rank")).alias("value_sum"),
        (rank_nulls_last("ret_20") + rank_nulls_last("ret_60")).alias("momentum_sum"),
        rank_nulls_last("roe").alias("quality_rank"),
        rank_nulls_last("vol_20").alias("volatility_rank"),
    )
    first = materialise(first, "ranks")
    sums = ["value_sum", "momentum_sum"]
    single = ["quality_rank", "volatility_rank"]
    second = min_ranks(first, ["ticker"], sums, dict.fromkeys(sums, rows), carry=single)
    return second.select(
        "ticker",
        (pct_rank("value_sum") * 100).alias("value_score"),
        _score(F.col("quality_rank"), rows).alias("quality_score"),
        (pct_rank("momentum_sum") * 100).alias("momentum_score"),
        F.lit(0.0).alias("supply_score"),
        _score(F.col("volatility_rank"), rows).alias("volatility_score"),
    )


def factor_scores(universe: DataFrame, rows: int | None = None, low_is_good: bool = False) -> DataFrame:
    """Instrument, name, price columns where present, and the five scores rounded to 2 decimals."""
    if rows is None:
        universe = materialise(universe, "universe")
        rows = universe.count()
    kept = _BASE + [c for c in _OPTIONAL if c in universe.columns]
    raw = raw_factor_scores(universe, rows, low_is_good)
    return (
        universe.select(*kept)
        .join(raw, "ticker")
        .select(*kept, *[round_half_even(F.col(c)).alias(c) for c in SCORES])
    )
