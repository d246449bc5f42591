import datetime as dt

import pytest

from quantloom.operators import fundamentals as fund
from quantloom.plans import training
from quantloom.sources import readers


def _bars(spark, spans):
    rows = []
    for ticker, first, n in spans:
        rows += [(ticker, first + dt.timedelta(days=i), 100.0 + i % 7, 10) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume long")


def _statements(spark, rows):
    return spark.createDataFrame(rows, "ticker string, year int, account string, amount_raw string")


def test_pivot_averages_duplicates_and_filters_first(spark):
    rows = [
        ("A", 2020, "net_income", "1,000"),
        ("A", 2020, "net_income", "3,000"),
        ("A", 2020, "total_equity", "-"),
        ("B", 2020, "revenue", "5"),
        ("C", 2020, "net_income", "-"),
        ("D", 2020, "total_equity", "8"),
    ]
    got = {r["ticker"]: (r["net_income"], r["total_equity"]) for r in fund.pivot_statements(_statements(spark, rows)).collect()}
    assert got == {"A": (2000.0, None), "D": (None, 8.0)}


def test_fill_forward_then_back(spark):
    bars = _bars(spark, [("A", dt.date(2019, 12, 1), 800), ("B", dt.date(2020, 1, 1), 400)])
    rows = [
        ("A", 2020, "net_income", "10"),
        ("A", 2020, "total_equity", "20"),
        ("A", 2018, "net_income", "99"),  # no bars in that year: not used
        ("B", 2020, "net_income", "7"),  # no equity in any year: the ticker is dropped
    ]
    filled = fund.filled_amounts(bars, _statements(spark, rows), range(2018, 2022))
    got = {(r["ticker"], r["year"]): (r["net_income"], r["total_equity"]) for r in filled.collect()}
    assert got == {("A", y): (10.0, 20.0) for y in (2019, 2020, 2021, 2022)}
    joined = fund.with_fundamentals(bars, filled)
    assert joined.count() == 800 and joined.where("net_income = 10 and total_equity = 20").count() == 800


def test_lagged_years(spark):
    bars = _bars(spark, [("A", dt.date(2020, 1, 1), 731)])
    rows = [("A", y, a, str(y)) for y in (2019, 2020, 2021) for a in fund.ACCOUNTS]
    same = fund.filled_amounts(bars, _statements(spark, rows), range(2019, 2022))
    lagged = fund.filled_amounts(bars, _statements(spark, rows), range(2019, 2022), lag_years=1)
    assert {(r["year"], r["net_income"]) for r in same.collect()} == {(2020, 2020.0), (2021, 2021.0)}
    assert {(r["year"], r["net_income"]) for r in lagged.collect()} == {(2020, 2019.0), (2021, 2020.0)}


def test_guarded_and_unguarded_ratios(spark):
    rows = [("A", 10.0, 100, -50.0, 200.0), ("B", 10.0, 100, 0.0, -5.0), ("C", 10.0, 100, None, 10.0)]
    df = spark.createDataFrame(rows, "ticker string, last_close double, shares long, net_income double, total_equity double")
    serve = {r["ticker"]: (r["per"], r["pbr"], r["roe"]) for r in fund.with_latest_ratios(df).collect()}
    assert serve == {"A": (None, 5.0, -0.25), "B": (None, None, None), "C": (None, 100.0, None)}
    train = fund.with_history_ratios(df.withColumnRenamed("last_close", "close"))
    got = {r["ticker"]: (r["per"], r["pbr"], r["roe"]) for r in train.collect()}
    assert got == {"A": (-20.0, 5.0, -0.25), "B": (None, -200.0, 0.0), "C": (None, 100.0, None)}


def test_training_rows_drop_short_unmapped_and_zero(spark):
    as_of = dt.date(2022, 6, 30)
    first = as_of - dt.timedelta(days=129)
    names = ["KEEP", "SHORT", "UNMAPPED", "ZERO", "NONE"]
    bars = _bars(spark, [(t, as_of - dt.timedelta(days=118), 119) if t == "SHORT" else (t, first, 130) for t in names])
    listing = spark.createDataFrame([(t, t, 5) for t in names], "ticker string, name string, shares long")
    code_map = spark.createDataFrame([("1", t) for t in names if t != "UNMAPPED"], "corp_code string, ticker string")
    amounts = [
        (t, 2021, a, "0" if t == "ZERO" and a == "net_income" else "10")
        for t in names
        if t != "NONE"
        for a in fund.ACCOUNTS
    ]
    amounts += [(t, 2022, a, "10") for t in names if t == "NONE" for a in fund.ACCOUNTS]
    history = training.feature_history(listing, code_map, bars, _statements(spark, amounts), as_of)
    # 2021 statements have no bars in their year, so nobody has amounts yet.
    assert history.count() == 0
    amounts = [(t, 2022 if y == 2021 else y, a, x) for t, y, a, x in amounts if t != "NONE"]
    history = training.feature_history(
        listing, code_map, bars, _statements(spark, amounts), as_of + dt.timedelta(days=365)
    )
    assert {r["ticker"] for r in history.select("ticker").distinct().collect()} == {"KEEP", "ZERO"}
    rows = training.training_rows(history)
    assert {r["ticker"] for r in rows.select("ticker").distinct().collect()} == {"KEEP"}
    assert rows.count() == 130 - 60


def test_statement_documents(spark, tmp_path):
    ok = '{"status":"000","list":[{"stock_code":"005930","account_nm":"당기순이익","thstrm_amount":"1,234"},' \
         '{"stock_code":"005930","account_nm":"매출액","thstrm_amount":"9"}],"other":1}'
    for year, text in ((2021, ok), (2022, '{"status":"013"}'), (2023, ok)):
        folder = tmp_path / f"year={year}"
        folder.mkdir()
        (folder / "part.json").write_text(text + "\n", encoding="utf-8")
    got = readers.read_statements(spark, str(tmp_path), years=[2021, 2022])
    assert sorted(tuple(r) for r in got.collect()) == [
        ("005930", 2021, "net_income", "1,234"),
        ("005930", 2021, "매출액", "9"),
    ]


def test_code_map_round_trip(spark, tmp_path):
    companies = spark.createDataFrame(
        [("00000001", "000020"), ("00000002", ""), ("00000003", None)], readers.COMPANY_SCHEMA
    )
    path = str(tmp_path / "map")
    readers.write_code_map(readers.build_code_map(companies), path)
    assert [tuple(r) for r in readers.read_code_map(spark, path).collect()] == [("00000001", "000020")]
    marked = tmp_path / "marked.csv"
    marked.write_bytes("﻿corp_code,ticker\n00000001,000020\n".encode())
    assert [tuple(r) for r in readers.read_code_map(spark, str(marked)).collect()] == [("00000001", "000020")]


def test_listing_filter(spark, tmp_path):
    rows = [("1", "한국스팩1호", 10), ("2", "좋은리츠", 10), ("3", "A", 0), ("4", "B", 5), ("5", None, 5)]
    path = str(tmp_path / "listing")
    spark.createDataFrame(rows, readers.LISTING_SCHEMA).write.parquet(path)
    assert [tuple(r) for r in readers.tradable(readers.read_listing(spark, path)).collect()] == [("4", "B", 5)]


def test_stored_bars_prune_by_year(spark, tmp_path):
    path = str(tmp_path / "bars")
    readers.write_bars(_bars(spark, [("A", dt.date(2019, 12, 30), 800)]), path)
    got = readers.read_stored_bars(spark, path, dt.date(2020, 12, 30), dt.date(2021, 1, 3))
    assert got.count() == 5 and got.columns == ["ticker", "date", "close", "volume"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan


@pytest.mark.parametrize("days", [1, 30])
def test_date_range_is_inclusive(spark, days):
    bars = _bars(spark, [("A", dt.date(2020, 1, 1), 60)])
    as_of = readers.as_of_date(bars)
    assert readers.in_range(bars, readers.days_before(as_of, days), as_of).count() == days + 1
