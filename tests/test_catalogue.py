"""Every catalogue query must return the same rows as its SQL."""

import pytest
from check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from quantloom.plans.catalog import QUERIES
from quantloom.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# What is learned has no SQL: tests/test_learned_queries.py recomputes it in plain Python.
LEARNED = {"forest_search", "forest_holdout", "ml_score", "ml_ranking", "dl_trend_score", "trend_accuracy"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - LEARNED == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) == ""


def test_entry(spark):
    ranked = entry(spark)
    assert [r["final_rank"] for r in ranked.collect()] == list(range(1, ranked.count() + 1))
