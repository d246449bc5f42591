import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import series
from quantloom.operators import sequences as seq

DAY = dt.date(2000, 1, 1)


def _bars(spark, lengths, seed=3):
    rng = np.random.default_rng(seed)
    frames = []
    for ticker, n in lengths.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        dates = [DAY + dt.timedelta(days=i) for i in range(n)]
        frames.append(pd.DataFrame({"ticker": ticker, "date": dates, "close": close, "volume": rng.integers(1, 9, n)}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def _ema(x, n):
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = out[i - 1] + 2 / (n + 1) * (x[i] - out[i - 1])
    return out


def _expected(close):
    """Plain loops per series."""
    n = len(close)
    out = {c: np.full(n, np.nan) for c in ("ret_20", "ret_60", "vol_20", "rsi_14")}
    up = down = 0.0
    for i in range(n):
        for back in (20, 60):
            if i >= back:
                out[f"ret_{back}"][i] = close[i] / close[i - back] - 1
        if i >= 19:
            last = close[i - 19 : i + 1]
            out["vol_20"][i] = np.sqrt(((last - last.mean()) ** 2).sum() / 19) / last.mean()
        if i:
            move = close[i] - close[i - 1]
            up, down = up * 13 / 14 + max(move, 0.0), down * 13 / 14 + max(-move, 0.0)
            if i >= 14 and up + down:
                out["rsi_14"][i] = 100 * up / (up + down)
    macd = _ema(close, 12) - _ema(close, 26)
    signal = np.full(n, np.nan)
    if n > 25:
        signal[25:] = _ema(macd[25:], 9)
    target = [int(i + 20 < n and close[i + 20] / close[i] > 1.05) for i in range(n)]
    return pd.DataFrame({**out, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "target": target})


COLUMNS = [*series.PRICE_FEATURES, "target"]


@pytest.mark.parametrize("sizes", [{}, {"segment_days": 100, "block_rows": 32}, {"segment_days": 7, "block_rows": 5}, {"segment_days": 5_000}])
@pytest.mark.parametrize("longest", [None, 3_500])
def test_features_equal_recursion(spark, sizes, longest):
    pdf, bars = _bars(spark, {"A": 3_500, "B": 61, "C": 15, "D": 1_100, "E": 1})
    got = series.featured(bars, COLUMNS, longest, **sizes).toPandas().sort_values(["ticker", "date"])
    assert len(got) == len(pdf)
    for ticker, part in got.groupby("ticker"):
        want = _expected(pdf.loc[pdf["ticker"] == ticker, "close"].to_numpy())
        for c in want.columns:
            np.testing.assert_allclose(
                part[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float), rtol=1e-7, atol=1e-9, err_msg=f"{ticker} {c}"
            )


def test_twenty_thousand_rows_of_one_series_in_sparse_and_dense_segments(spark):
    """One series far beyond a window of weights: five rows a day, then one a year."""
    rng = np.random.default_rng(8)
    start = dt.datetime(1990, 1, 1)
    times = [start + dt.timedelta(hours=4 * i) for i in range(20_000)] + [dt.datetime(2010 + k, 5, 5) for k in range(40)]
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(times))))
    bars = spark.createDataFrame([("A", t, float(c)) for t, c in zip(times, close, strict=True)], "ticker string, date timestamp, close double")
    got = series.featured(bars.repartition(6), COLUMNS).toPandas().sort_values("date")
    want = _expected(close)
    for c in want.columns:
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float), rtol=1e-6, atol=1e-9, err_msg=c)


def test_sequences_do_not_depend_on_the_segments(spark):
    pdf, bars = _bars(spark, {"A": 2_600, "B": 90, "C": 79})
    found = seq.labelled(seq.sequences(bars, segment_days=100)).select("ticker", "date", "sequence", "target").toPandas()
    assert found.groupby("ticker").size().to_dict() == {"A": 2_600 - 79, "B": 11}
    found = found.set_index(["ticker", "date"])
    for ticker, part in pdf.groupby("ticker"):
        close = part.close.to_numpy()
        scaled = (close - close.min()) / (close.max() - close.min())
        for i in range(59, len(close) - 20):
            row = found.loc[(ticker, part.date.iloc[i])]
            np.testing.assert_allclose(row.sequence, scaled[i - 59 : i + 1], atol=1e-12)
            assert row.target == int(scaled[i + 20] > scaled[i])


def test_history_gate(spark):
    _, bars = _bars(spark, {"A": 60, "B": 61, "C": 119, "D": 120, "E": 2_100})
    for minimum, kept in ((61, "BCDE"), (120, "DE")):
        for gated in (series.history_gate(bars, minimum), series.featured(bars, ["ret_20"], min_rows=minimum, segment_days=50)):
            rows = {r["ticker"]: r["count"] for r in gated.groupBy("ticker").count().collect()}
            assert sorted(rows) == list(kept) and rows.get("E") == 2_100


def test_bars_are_exchanged_by_segment_only(spark):
    """Rows move by (ticker, segment); by ticker alone move summaries."""
    _, bars = _bars(spark, {"A": 200, "B": 200})
    plan = series.featured(bars, COLUMNS, 200)._jdf.queryExecution().executedPlan().toString()
    by_ticker = [line for line in plan.splitlines() if "Exchange hashpartitioning(ticker" in line and "_segment" not in line]
    moved = [line for line in plan.splitlines() if "Sort [ticker" in line and "date" in line and "_segment" not in line]
    assert by_ticker and not moved


def test_no_window_over_bars(spark):
    """What lies around a segment is joined to one row for each segment: no bar goes through a sort by date or a window."""
    _, bars = _bars(spark, {"A": 200, "B": 200})
    plan = series.featured(bars, COLUMNS, 200)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if ("Sort [" in line or "Window [" in line) and "date#" in line]


@pytest.mark.parametrize("segment_days", [100, 2_048])
def test_long_gaps_are_bridged(spark, segment_days):
    """Closes missing for many segments: returns use the last known close, indicators wait for the next move."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for ticker, gap in (("A", range(1_300, 3_700)), ("B", range(0)), ("C", range(5, 2_500)), ("D", range(0, 400))):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 3_900)))
        values = [None if i in gap else float(c) for i, c in enumerate(close)]
        rows += [(ticker, DAY + dt.timedelta(days=i), c) for i, c in enumerate(values)]
        want[ticker] = _with_gaps(values)
    bars = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(5)
    got = series.featured(bars, COLUMNS, segment_days=segment_days, block_rows=64).toPandas().sort_values(["ticker", "date"])
    for ticker, part in got.groupby("ticker"):
        for c in want[ticker].columns:
            np.testing.assert_allclose(
                part[c].to_numpy(dtype=float), want[ticker][c].to_numpy(dtype=float), rtol=1e-7, atol=1e-9, err_msg=f"{ticker} {c}"
            )


def _with_gaps(values):
    """Plain loops over a series with missing closes; a stretch without a move leaves the last RSI standing."""
    n = len(values)
    raw = np.array([np.nan if v is None else v for v in values])
    padded = pd.Series(raw).ffill().to_numpy()
    out = {c: np.full(n, np.nan) for c in ("ret_20", "ret_60", "rsi_14", "macd", "macd_signal")}
    fast = slow = signal = 0.0
    up = down = 0.0
    known, last = 0, np.nan
    for i in range(n):
        for back in (20, 60):
            if i >= back:
                out[f"ret_{back}"][i] = padded[i] / padded[i - back] - 1
        move = raw[i] - raw[i - 1] if i else np.nan
        up, down = up * 13 / 14, down * 13 / 14
        if not np.isnan(move):
            up, down, known = up + max(move, 0.0), down + max(-move, 0.0), known + 1
            last = 100 * up / (up + down)
        if known >= 14:
            out["rsi_14"][i] = last
        if not np.isnan(padded[i]):
            fast = fast + padded[i] / 12 if i <= 11 else fast * 11 / 13 + padded[i] * 2 / 13
            slow = slow + padded[i] / 26 if i <= 25 else slow * 25 / 27 + padded[i] * 2 / 27
            if i >= 25:
                out["macd"][i] = fast - slow
                signal = signal + (fast - slow) / 9 if i <= 33 else signal * 0.8 + (fast - slow) * 0.2
            if i >= 33:
                out["macd_signal"][i] = signal
    return pd.DataFrame(out)


def test_range_of_a_long_series(spark):
    rows = [("A", DAY + dt.timedelta(days=i), float(i)) for i in range(6_000)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = [r["scaled"] for r in seq.with_scaled_close(bars).orderBy("date").collect()]
    np.testing.assert_allclose(got, np.arange(6_000) / 5_999)


def test_a_wrong_bound_is_an_error(spark):
    rows = [("A", DAY + dt.timedelta(days=i), float(1 + i % 9)) for i in range(5_000)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    with pytest.raises(Exception, match="longer than the bound"):
        series.featured(bars, ["macd"], longest=1, segment_days=30).collect()


def test_label_tail_is_zero(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 100 * 1.1**i) for i in range(25)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = [r["target"] for r in series.featured(bars, ["target"]).orderBy("date").collect()]
    assert got == [1] * 5 + [0] * 20


def test_gap_is_padded_for_returns_only(spark):
    rows = [("A", DAY + dt.timedelta(days=i), None if i == 25 else 100.0 + i) for i in range(50)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = series.featured(bars, ["ret_20", "vol_20"], segment_days=10).orderBy("date").collect()
    want = pd.Series([r[2] for r in rows]).ffill().pct_change(20)
    np.testing.assert_allclose([r["ret_20"] for r in got[20:]], want[20:])
    assert [r["vol_20"] is None for r in got] == [True] * 19 + [False] * 6 + [True] * 20 + [False] * 5


def test_constant_series(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 5.0) for i in range(70)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    last = series.featured(bars).orderBy("date").collect()[-1]
    assert (last["rsi_14"], last["vol_20"], last["ret_20"]) == (None, 0.0, 0.0)
    assert seq.with_scaled_close(bars).agg({"scaled": "max"}).first()[0] == 0.0


def test_latest(spark):
    pdf, bars = _bars(spark, {"A": 30, "B": 2})
    got = {r["ticker"]: r["close"] for r in series.latest(bars, ["close"]).collect()}
    assert got == pdf.groupby("ticker")["close"].last().to_dict()
