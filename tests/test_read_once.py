"""Steps that read their rows several times get them stored, so that nothing before them is done again."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quantloom.operators import series
from quantloom.plans import catalog
from quantloom.sources import derived


def _counted(spark, df, column, kind):
    """The rows, and how often this column of one of them has been computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(pass_on, kind)(column)), seen


def test_split_computes_its_rows_once(spark):
    day = dt.date(2020, 1, 1)
    rows = [(f"T{i % 7}", day + dt.timedelta(days=i), int(i % 3 == 0)) for i in range(300)]
    counted, seen = _counted(spark, spark.createDataFrame(rows, "ticker string, date date, target int"), "target", "int")
    got = {(r.target, r.is_test): r.rows for r in catalog.stratified_split_sizes(SimpleNamespace(training_rows=counted)).collect()}
    assert got == {(0, True): 60, (0, False): 140, (1, True): 30, (1, False): 70}
    assert seen.value == 300


def test_ticks_are_built_once_and_cut_into_short_segments(spark, monkeypatch):
    start = dt.datetime(2020, 1, 1)
    rows = [("A" if i % 3 else "B", start + dt.timedelta(hours=7 * i), 100.0 + (i * 37) % 11) for i in range(600)]
    plain = spark.createDataFrame(rows, "ticker string, date timestamp, close double")
    counted, seen = _counted(spark, plain, "close", "double")
    monkeypatch.setattr(derived, "ticks", lambda *_: counted)
    got = {(r.ticker, r.moment): r for r in catalog.tick_features(SimpleNamespace(spark=spark, sf_dir="none")).collect()}
    assert seen.value == len(got) == 600
    whole = series.featured(plain, [*series.PRICE_FEATURES, "target"]).withColumn("moment", F.unix_micros("date"))
    for want in whole.collect():
        row = got[want.ticker, want.moment]
        assert row.target == want.target
        for c in series.PRICE_FEATURES:
            assert (row[c] is None) == (want[c] is None) and (want[c] is None or row[c] == pytest.approx(want[c], abs=1e-3))
