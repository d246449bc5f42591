import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import blend as bl
from quantloom.operators.impute import impute, medians
from quantloom.operators.scores import SCORES, factor_scores


def _universe(n=400, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "ticker": [f"{i:04d}" for i in range(n)],
            "name": [f"n{i}" for i in range(n)],
            "last_close": rng.random(n).round(2),
            "market_cap_eok": rng.random(n),
            "per": rng.normal(5, 10, n).round(1),
            "pbr": rng.normal(1, 1, n).round(1),
            "roe": rng.normal(0, 1, n).round(2),
            "ret_20": rng.normal(0, 1, n).round(2),
            "ret_60": rng.normal(0, 1, n).round(2),
            "vol_20": rng.random(n).round(2),
        }
    )
    for c in ("per", "pbr", "roe", "ret_20", "vol_20"):
        pdf.loc[rng.random(n) < 0.1, c] = np.nan
    return pdf


def _spark(spark, pdf):
    numbers = [c for c in pdf.columns if c not in ("ticker", "name")]
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def _expected(pdf):
    """The scores by the definition of a rank: one more than the number of smaller values."""

    def rank(values):
        return np.array([1 + (values < v).sum() for v in values])

    def last(column):
        values = column.to_numpy(dtype=float)
        return rank(np.where(np.isnan(values), np.inf, values))

    def pct(values):
        return pd.Series(100 * rank(np.asarray(values)) / len(values))

    def cheap(column):
        values = column.to_numpy(dtype=float)
        out = np.full(len(values), -np.inf)
        out[values > 0] = 1 / values[values > 0]
        return rank(out)

    n = len(pdf)
    return pd.DataFrame(
        {
            "ticker": pdf["ticker"],
            "value_score": pct(cheap(pdf["per"]) + cheap(pdf["pbr"])).round(2),
            "quality_score": np.round(last(pdf["roe"]) / n * 100, 2),
            "momentum_score": pct(last(pdf["ret_20"]) + last(pdf["ret_60"])).round(2),
            "supply_score": 0.0,
            "volatility_score": np.round(last(pdf["vol_20"]) / n * 100, 2),
        }
    )


def test_factor_scores_equal_definition(spark):
    pdf = _universe()
    got = factor_scores(_spark(spark, pdf)).toPandas().sort_values("ticker")
    want = _expected(pdf)
    for c in SCORES:
        np.testing.assert_array_equal(got[c].to_numpy(), want[c].to_numpy(), err_msg=c)


def test_low_volatility_option(spark):
    pdf = _universe(50).fillna(0.5)
    pdf["vol_20"] = np.arange(50) / 100
    high = factor_scores(_spark(spark, pdf)).toPandas().set_index("ticker")["volatility_score"]
    low = factor_scores(_spark(spark, pdf), low_is_good=True).toPandas().set_index("ticker")["volatility_score"]
    assert high["0049"] == 100 and low["0000"] == 100 and low["0049"] == 2


def test_final_ranking_equals_pandas(spark):
    pdf = _universe()
    scored = factor_scores(_spark(spark, pdf))
    got = bl.final_ranking(scored).toPandas()
    want = _expected(pdf)
    raw = sum(want[c] * w for c, w in bl.WEIGHTS.items() if w > 0 and c in want).round(9)
    want["full"] = 100 * (raw - raw.min()) / (raw.max() - raw.min())
    want = want.sort_values(["full", "ticker"], ascending=[False, True])
    assert list(got["ticker"]) == list(want["ticker"])
    assert list(got["final_rank"]) == list(range(1, len(pdf) + 1))
    np.testing.assert_array_equal(got["final_score"], want["full"].round(2))


def test_blend_ignores_missing_zero_weight_and_absent(spark):
    df = spark.createDataFrame(
        [("A", 50.0, None, 0.5, 80.0), ("B", None, 10.0, None, 0.0)],
        "ticker string, value_score double, momentum_score double, ml_pred_proba double, sentiment_score double",
    )
    assert [r[0] for r in df.orderBy("ticker").select(bl.blend(df)).collect()] == [10.1, 3.0]


def test_scaling_the_weights_changes_nothing(spark):
    scored = factor_scores(_spark(spark, _universe(120)))
    plain = bl.final_ranking(scored).select("ticker", "final_rank", "final_score")
    scaled = bl.final_ranking(scored, {c: w * 4 for c, w in bl.WEIGHTS.items()})
    assert plain.exceptAll(scaled.select(*plain.columns)).count() == 0


def test_equal_scores_give_fifty_and_ticker_order(spark):
    df = spark.createDataFrame([(t, 5.0) for t in "CADB"], "ticker string, value_score double")
    got = [tuple(r) for r in bl.final_ranking(df).select("ticker", "final_score", "final_rank").collect()]
    assert got == [("A", 50.0, 1), ("B", 50.0, 2), ("C", 50.0, 3), ("D", 50.0, 4)]


def test_empty_input_stays_empty(spark):
    empty = _spark(spark, _universe(5)).limit(0)
    assert bl.final_ranking(factor_scores(empty)).count() == 0


def test_display_keeps_present_columns_in_order(spark):
    df = spark.createDataFrame([("A", 0.25, 1, 7.0)], "name string, ml_pred_proba double, final_rank int, extra double")
    shown = bl.display(df)
    assert shown.columns == ["final_rank", "name", "up_probability_pct"]
    assert tuple(shown.first()) == (1, "A", 25.0)


def test_medians_equal_numpy(spark):
    rng = np.random.default_rng(2)
    n = 5_001
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.random(n)})
    pdf.loc[: n // 3, "c"] = 0.5
    pdf.loc[0, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = medians(df, ["a", "b", "c"])
    for c in "abc":
        assert got[c] == pytest.approx(np.nanmedian(pdf[c]), abs=1e-12)


def test_impute(spark):
    df = spark.createDataFrame([("A", 1.0, None), (None, 3.0, None), ("C", None, None)], "t string, x double, y double")
    got = impute(df, ["x", "y"], medians(df, ["x", "y"])).collect()
    assert [tuple(r) for r in got] == [("A", 1.0, 0.0), ("0", 3.0, 0.0), ("C", 2.0, 0.0)]
