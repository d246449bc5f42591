import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators.order import counts_of, min_ranks, pct_rank, rank_nulls_last, row_positions


def _frame(spark, n=5_000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n).round(2)
    a[rng.random(n) < 0.33] = 1.5  # one value holds a third of all rows
    b = rng.integers(0, 40, n).astype(float)
    b[rng.random(n) < 0.2] = -np.inf
    c = np.where(rng.random(n) < 0.3, np.nan, rng.random(n))
    pdf = pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    return pdf, df


def test_min_ranks_equal_pandas(spark):
    pdf, df = _frame(spark)
    got = min_ranks(df, ["id"], ["a", "b", "c"]).toPandas().sort_values("id")
    for c in "abc":
        want = pdf[c].rank(method="min")
        np.testing.assert_array_equal(got[f"{c}_rank"].to_numpy(dtype=float), want.to_numpy())
        assert set(got[f"{c}_n"]) == {int(pdf[c].notna().sum())}


def test_known_ranks(spark):
    values = [3.0, 1.0, None, 1.0, None, float("-inf")]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    ranked = min_ranks(df, ["id"], ["v"]).select("id", pct_rank("v"), rank_nulls_last("v") / 6)
    rows = sorted(ranked.collect())
    assert [r[1] for r in rows] == [1.0, 0.5, None, 0.5, None, 0.25]
    assert [round(r[2] * 6) for r in rows] == [4, 2, 5, 2, 5, 1]


def test_all_equal_and_all_missing(spark):
    df = spark.range(1_000).select("id", F.lit(7.0).alias("v"), F.lit(None).cast("double").alias("w"))
    got = min_ranks(df, ["id"], ["v", "w"]).agg(F.max("v_rank"), F.count("w_rank")).first()
    assert tuple(got) == (1, 0)


def test_ranks_plan_no_single_task(spark):
    _, df = _frame(spark)
    counts = counts_of(df, ["a"])
    plan = min_ranks(df, ["id"], ["a"], counts)._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_equal_pandas(spark, parts):
    pdf, df = _frame(spark)
    got = row_positions(df.repartition(parts), [F.desc("a"), F.asc("id")]).toPandas().sort_values("id")
    order = pdf.sort_values(["a", "id"], ascending=[False, True])
    want = pd.Series(range(1, len(pdf) + 1), index=order["id"]).sort_index()
    np.testing.assert_array_equal(got["position"].to_numpy(), want.to_numpy())


def test_positions_over_several_coalesced_partitions(spark):
    pdf, df = _frame(spark, 20_000)
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {name: spark.conf.get(name, None) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        placed = row_positions(df, ["b", "id"])
        got = placed.toPandas().sort_values("id")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(placed.inputFiles()) > 1
    order = pdf.sort_values(["b", "id"])
    want = pd.Series(range(1, len(pdf) + 1), index=order["id"]).sort_index()
    np.testing.assert_array_equal(got["position"].to_numpy(), want.to_numpy())
