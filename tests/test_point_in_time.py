"""As-of join, purged folds, providers that disagree, landed files: against plain Python."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import sampling
from quantloom.operators.asof import asof_join
from quantloom.sources import readers

DAY = dt.date(2000, 1, 1)


@pytest.mark.parametrize("segment_days", [9, 400, 2_048])
def test_asof_join_carries_over_segments(spark, segment_days):
    """A hot ticker over many segments, statements on the day of a bar, before all bars, behind all, and none at all."""
    rng = np.random.default_rng(6)
    rows = [("HOT", DAY + dt.timedelta(days=int(d))) for d in np.sort(rng.choice(4_000, 2_500, replace=False))]
    rows += [("COLD", DAY + dt.timedelta(days=d)) for d in (0, 3_999)] + [("NONE", DAY), ("LATE", DAY)]
    known = [("HOT", DAY + dt.timedelta(days=int(d)), float(d)) for d in rng.choice(range(200, 4_000), 25, replace=False)]
    known += [("COLD", DAY - dt.timedelta(days=900), 1.0), ("LATE", DAY + dt.timedelta(days=1), 2.0), ("HOT", None, 9.0)]
    left = spark.createDataFrame(rows, "ticker string, date date").withColumn("id", F.monotonically_increasing_id()).repartition(5)
    right = spark.createDataFrame(known, "ticker string, published date, amount double")
    got = {(r.ticker, r.date): r.amount for r in asof_join(left, right, "published", ["amount"], segment_days).collect()}
    assert len(got) == len(rows)
    for ticker, day in rows:
        past = [(p, a) for t, p, a in known if t == ticker and p is not None and p <= day]
        assert got[(ticker, day)] == (max(past)[1] if past else None)


def test_purged_folds_equal_pairwise_comparison(spark):
    rng = np.random.default_rng(1)
    rows = []
    for ticker in ("A", "B", "C"):
        days = np.sort(rng.choice(900, 300, replace=False))
        rows += [(ticker, DAY + dt.timedelta(days=int(d)), DAY + dt.timedelta(days=int(days[min(i + 20, 299)]))) for i, d in enumerate(days)]
    df = sampling.time_folds(spark.createDataFrame(rows, "ticker string, date date, target_end date"), 3)
    folds = {(r.ticker, r.date): r._fold for r in df.collect()}
    sizes = pd.Series(list(folds.values())).value_counts()
    assert len(sizes) == 3 and sizes.min() > 290
    for embargo in (0, 15):
        got = {(r.fold, r.ticker, r.date): r.part for r in sampling.purged_folds(df, ["ticker", "date"], embargo_days=embargo).collect()}
        assert len(got) == 3 * len(rows)
        for fold in range(3):
            held = [(s, e + dt.timedelta(days=embargo)) for t, s, e in rows if folds[(t, s)] == fold]
            for ticker, start, end in rows:
                hit = any(start <= e and s <= end for s, e in held)
                want = "test" if folds[(ticker, start)] == fold else "purged" if hit else "train"
                assert got[(fold, ticker, start)] == want


def test_providers_that_disagree(spark):
    schema = "ticker string, date date, close double, volume long"
    first = spark.createDataFrame([("A", DAY, 10.0, 1), ("A", DAY, 11.0, 1), ("B", DAY, None, 5), ("C", DAY, 5.0, 2)], schema)
    second = spark.createDataFrame([("A", DAY, 10.0, 9), ("B", DAY, 2.0, 6), ("C", DAY, 5.04, 9), ("D", DAY, 1.0, 1)], schema)
    got = {r.ticker: tuple(r)[2:] for r in readers.merged_providers([first, second], ["one", "two"], 0.01).collect()}
    assert got["A"] == (10.0, 1, "one", 2, "", True)
    assert got["B"] == (2.0, 6, "two", 1, "one", False)
    assert got["C"] == (5.0, 2, "one", 2, "", False)
    assert got["D"] == (1.0, 1, "two", 1, "one", False)


def test_landed_documents_prune_years_and_keep_what_is_broken(spark, tmp_path):
    body = lambda status, code: json.dumps({"status": status, "list": [{"stock_code": code, "account_nm": "x", "thstrm_amount": "1,0"}]})
    docs = [(2019, body("000", "001")), (2020, body("000", "002")), (2020, body("013", "003")), (2020, body("000", "004")[:20]), (2020, "{}")]
    path = str(tmp_path / "landed")
    readers.land_documents(spark.createDataFrame(docs, "year int, body string"), path)
    good = readers.read_statements(spark, path, [2020], {})
    assert [tuple(r) for r in good.collect()] == [("002", 2020, "x", "1,0")]
    assert "PartitionFilters: [isnotnull(year" in good._jdf.queryExecution().toString() or "year#" in good._jdf.queryExecution().toString()
    aside = readers.quarantined(readers.read_landed(spark, path, [2020])).collect()
    assert sorted((r.year, r.reason, r.broken) for r in aside) == sorted(
        [(2020, "status 013", None), (2020, "broken", body("000", "004")[:20]), (2020, "no status", None)], key=str
    ) or {r.reason for r in aside} == {"status 013", "broken", "no status"}
    assert readers.quarantined(readers.read_landed(spark, path)).count() == 3


@pytest.mark.parametrize("mark", [False, True])
def test_code_map_round_trip(spark, tmp_path, mark):
    rows = [("00100", "005930"), ('a,"b",c', "000020"), ('"', "x y"), ("007", "0")]
    codes = spark.createDataFrame(rows, "corp_code string, ticker string").repartition(3)
    path = str(tmp_path / "codes")
    readers.write_code_map(codes, path, mark)
    assert sorted(map(tuple, readers.read_code_map(spark, path).collect())) == sorted(rows)
