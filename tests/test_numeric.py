import numpy as np
from pyspark.sql import functions as F

from quantloom.functions import numeric as num


def _column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_amounts(spark):
    raw = ["1,234", "-", "", "(1)", " 12 ", "-5", "1e3", None]
    assert _column(spark, raw, "string", num.parse_amount) == [1234.0, None, None, None, 12.0, -5.0, 1000.0, None]


def test_rounding_is_numpys(spark):
    values = [3.125, 2.675, 1.005, 1.015, 2.665, -3.125, 0.125, 99.995, 0.0, 41.665]
    assert _column(spark, values, "double", num.round_half_even) == list(np.round(values, 2))


def test_infinities_become_null(spark):
    values = [1.0, float("inf"), float("-inf"), float("nan"), None]
    assert _column(spark, values, "double", num.finite) == [1.0, None, None, None, None]


def test_inverse_floor(spark):
    floor = float("-inf")
    assert _column(spark, [4.0, 0.0, -2.0, None], "double", num.inverse_or_floor) == [0.25, floor, floor, floor]


def test_ratios(spark):
    df = spark.createDataFrame([(10.0, 4.0), (10.0, 0.0), (10.0, -2.0), (10.0, None)], "a double, b double")
    rows = df.select(num.ratio(F.col("a"), F.col("b")), num.ratio_if_positive(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(2.5, 2.5), (None, None), (-5.0, None), (None, None)]


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20_000).select(num.unit_draw(F.lit(1), F.col("id")).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01
    assert df.exceptAll(df).count() == 0
