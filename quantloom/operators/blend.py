"""Weighted blend, min-max scaling and the final order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import round_half_even
from quantloom.operators.order import row_positions

# Weight per score. The probability stays in 0..1 while the other scores are 0..100,
# so it moves the blend by at most 0.2 points.
WEIGHTS = {
    "value_score": 0.20,
    "quality_score": 0.20,
    "momentum_score": 0.30,
    "supply_score": 0.00,
    "volatility_score": 0.10,
    "ml_pred_proba": 0.20,
    "sentiment_score": 0.00,
    "dl_trend_score": 0.00,
}
# Sums of doubles differ in the last bits; blends closer than this are equal.
_BLEND_DIGITS = 9

# Order of the displayed columns.
DISPLAY_COLUMNS = {
    "final_rank": "final_rank",
    "name": "name",
    "last_close": "last_close_won",
    "final_score": "final_score_points",
    "ml_pred_proba": "up_probability_pct",
    "momentum_score": "momentum_points",
    "value_score": "value_points",
    "quality_score": "quality_points",
    "supply_score": "supply_points",
    "volatility_score": "volatility_points",
    "market_cap_eok": "market_cap_eok",
}


def blend(df: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Sum of weight * score over the present columns with a positive weight; missing scores count 0."""
    active = {c: w for c, w in weights.items() if w > 0 and c in df.columns}
    total = F.lit(0.0)
    for column, weight in active.items():
        total = total + F.coalesce(F.col(column), F.lit(0.0)) * weight
    return F.round(total, _BLEND_DIGITS)


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale a column to 0..100; all equal gives 50. The statistics are one broadcast row."""
    stats = df.agg(F.min(column).alias("_min"), F.max(column).alias("_max"))
    span = F.col("_max") - F.col("_min")
    scaled = F.when(span > 0, 100 * (F.col(column) - F.col("_min")) / span).otherwise(F.lit(50.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled).drop("_min", "_max")


def join_predictions(scored: DataFrame, predictions: DataFrame) -> DataFrame:
    return scored.join(predictions, "ticker", "left")


def final_rank(df: DataFrame, column: str = "final_score", key: str = "ticker") -> DataFrame:
    """Unique positions 1..n by descending score; equal scores are ordered by `key`."""
    return row_positions(df, [F.desc_nulls_last(column), F.asc(key)], "final_rank")


def final_ranking(scored: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Blend, scale, rank on the unrounded score, round, and sort by rank."""
    scaled = min_max(scored.withColumn("_blend", blend(scored, weights)), "_blend", "final_score").drop("_blend")
    return (
        final_rank(scaled)
        .withColumn("final_score", round_half_even(F.col("final_score")))
        .orderBy("final_rank")
    )


def display(ranked: DataFrame) -> DataFrame:
    """The result table: probabilities in percent, unit names, fixed order, only present columns."""
    if "ml_pred_proba" in ranked.columns:
        ranked = ranked.withColumn("ml_pred_proba", F.col("ml_pred_proba") * 100)
    return ranked.select(*[F.col(c).alias(name) for c, name in DISPLAY_COLUMNS.items() if c in ranked.columns])
