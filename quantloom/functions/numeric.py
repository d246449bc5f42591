"""Scalar column expressions. Missing values are NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
WON_PER_EOK = 1e8


def finite(col: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(INF)), col)


def round_half_even(col: Column, digits: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back: how numpy rounds doubles."""
    scale = F.lit(10.0**digits)
    return F.rint(col * scale) / scale


def parse_amount(raw: Column) -> Column:
    """`'1,234'` -> 1234.0; text that is no number -> NULL."""
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_if_positive(numerator: Column, denominator: Column) -> Column:
    """Quotient only where the denominator is positive, else NULL."""
    return F.when(denominator > 0, ratio(numerator, denominator))


def inverse_or_floor(col: Column) -> Column:
    """1/x for positive x; -inf for zero, negative and missing values."""
    return F.when(col > 0, F.try_divide(F.lit(1.0), col)).otherwise(F.lit(-INF))


def market_cap(close: Column, shares: Column) -> Column:
    return close * shares


def unit_draw(*cols: Column) -> Column:
    """Repeatable number in [0, 1) from the given columns."""
    bits = 48
    low = F.xxhash64(*cols).bitwiseAND(F.lit((1 << bits) - 1))
    return low.cast("double") / F.lit(float(1 << bits))
