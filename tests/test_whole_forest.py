"""A forest is fitted on every training row, and its trees are the best ones that the drawn rows allow."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import forest, trees
from quantloom.operators.sampling import stratified_split
from quantloom.plans import catalog, training

NAMES = ["f0", "f1", "f2"]


def _planted(spark, n=1_500, seed=4):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES)
    pdf["f2"] = pdf["f2"].round()  # a few values only
    pdf["target"] = (pdf["f0"] + 0.5 * rng.normal(size=n) > 1.0).astype("int32")
    pdf["key"] = [f"k{i}" for i in range(n)]
    return pdf, spark.createDataFrame(pdf)


def _catalogue_rows(spark, n=4_000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(n, len(training.FEATURES))), columns=training.FEATURES)
    pdf["target"] = (pdf["ret_20"] + 0.3 * rng.normal(size=n) > 0.5).astype("int32")
    pdf["ticker"], pdf["date"] = [f"T{i % 40}" for i in range(n)], [dt.date(2020, 1, 1) + dt.timedelta(days=i // 40) for i in range(n)]
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def short_search(spark):
    """The catalogue's search over 4,000 rows, with fewer draws and trees."""
    real, fitted = forest.train_forest, []

    def short(rows, features, **more):
        return real(rows, features, n_iter=2, depths=(4,), trees=(3, 5), **more)

    def count(train, *more):
        fitted.append(train.count())
        return whole(train, *more)

    rows = _catalogue_rows(spark)
    whole = forest.Held.of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(forest, "train_forest", short)
        patch.setattr(forest.Held, "of", staticmethod(count))
        inputs = SimpleNamespace(spark=spark, sf_dir="whole-search", training_rows=rows)
        trained, path = catalog.searched(inputs)
    return rows, inputs, trained, path, fitted


def _balanced_size(rows):
    parts = stratified_split(rows, ["ticker", "date"]).where("not is_test")
    return 2 * max(r["count"] for r in parts.groupBy("target").count().collect())


def test_search_is_made_on_every_training_row(short_search):
    rows, _, trained, _, fitted = short_search
    size = _balanced_size(rows)
    assert size > 2 * 1_400 and fitted == [size]
    judged = trained.areas.groupBy("draw").agg(F.sum(F.col("positives") + F.col("negatives")).alias("n")).collect()
    assert [r.n for r in judged] == [size] * 2


def test_holdout_model_is_fitted_on_every_training_row(short_search):
    """The share at a tree's root is that of the rows drawn for it, from as many as there are: a whole number of them."""
    rows, inputs, trained, _, _ = short_search
    size = _balanced_size(rows)
    shares = [r.share for r in trained.model.nodes.where("node = 0").collect()]
    assert len(shares) == trained.params["numTrees"]
    for tree, share in enumerate(shares):
        drawn = np.random.default_rng([42, tree]).poisson(1.0, size).sum()
        assert share * drawn == pytest.approx(round(share * drawn), abs=1e-6)
    report = {r["class"]: r for r in catalog.forest_holdout(inputs).collect()}
    assert report["accuracy"].support == rows.count() - stratified_split(rows, ["ticker", "date"]).where("not is_test").count()
    assert report["0"].auc > 0.8


def test_stored_model_is_walked_some_trees_after_the_others(spark, short_search, monkeypatch):
    """A forest on all rows may be larger than what one task holds: the sums over groups of trees make the same probability."""
    rows, _, _, path, _ = short_search
    universe = rows.where("date = DATE'2020-01-05'").withColumn("ret_60", F.when(F.col("ticker") != "T3", F.col("ret_60")))
    model = forest.load_model(path)
    at_once = {r.ticker: r.ml_pred_proba for r in forest.score_instruments(model, universe).collect()}
    assert len(model.groups()) == 1 and len(at_once) == 40
    monkeypatch.setattr(forest, "WALK_NODES", 1 + max(r["count"] for r in model.nodes.groupBy("tree").count().collect()))
    parted = forest.load_model(path)
    assert len(parted.groups()) > 1 and parted.groups()[0][0] == 0
    assert [t for a, b in parted.groups() for t in range(a, b + 1)] == list(range(model.nodes.select("tree").distinct().count()))
    in_turn = {r.ticker: r.ml_pred_proba for r in forest.score_instruments(parted, universe).collect()}
    assert in_turn == pytest.approx(at_once, abs=1e-12)


def test_cuts_are_quantiles_of_all_rows(spark):
    pdf, df = _planted(spark)
    cuts = forest.feature_cuts(df, NAMES)
    for name, cut in zip(NAMES[:2], cuts[:2], strict=True):
        want = np.quantile(pdf[name], np.arange(1, trees.BINS) / trees.BINS, method="inverted_cdf")
        assert cut.tolist() == want.tolist()
    values = np.unique(pdf["f2"])
    assert 3 < len(values) <= trees.BINS and cuts[2].tolist() == values[:-1].tolist()
    assert trees.binned(pdf[["f2"]].to_numpy(), cuts[2:])[:, 0].tolist() == np.searchsorted(values, pdf["f2"]).tolist()


@pytest.mark.parametrize("weighted", [False, True])
def test_tree_takes_the_best_split_of_each_node(weighted):
    """One feature, so that no part of the features is drawn: the tree against splits found one by one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (400, 1)).astype(np.uint8)
    y = (rng.random(400) < np.where(x[:, 0] % 5 < 2, 0.8, 0.3)).astype(np.uint8)
    weight = np.where(y == 1, 1.75, 0.5) if weighted else None
    depth, leaf = 4, 9
    tree = trees.grown(x, y, weight, 42, 7, depth, leaf)
    times = np.random.default_rng([42, 7]).poisson(1.0, 400)
    mass = times * (1.0 if weight is None else weight)
    seen = 0

    def impure(rows):
        total = mass[rows].sum()
        up = mass[rows][y[rows] == 1].sum()
        return 2 * up * (total - up) / total if total else 0.0

    def follow(node, rows, level):
        nonlocal seen
        seen += 1
        assert tree["share"][node] == pytest.approx(mass[rows][y[rows] == 1].sum() / mass[rows].sum())
        found = {}
        for bound in range(12):
            left = x[rows, 0] <= bound
            if min(times[rows][left].sum(), times[rows][~left].sum()) >= leaf:
                found[bound] = impure(rows) - impure(rows[left]) - impure(rows[~left])
        best = max(found.values(), default=0.0)
        if level == depth or best < 1e-9:
            assert tree["left"][node] == tree["right"][node] == tree["feature"][node] == -1
            return
        bound = tree["bound"][node]
        assert tree["feature"][node] == 0 and found[bound] == pytest.approx(best, abs=1e-9)
        left = x[rows, 0] <= bound
        follow(tree["left"][node], rows[left], level + 1)
        follow(tree["right"][node], rows[~left], level + 1)

    follow(0, np.flatnonzero(times), 0)
    assert seen == len(tree["left"]) > 9 and tree["level"].max() <= depth


def test_forest_does_not_depend_on_the_order_of_rows(spark):
    _, df = _planted(spark, 600)
    cuts = forest.feature_cuts(df, NAMES)
    folded = df.withColumn("_fold", F.pmod(F.hash("key"), F.lit(3)))
    params = {"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 2}
    one, other = (
        forest.Held.of(rows, NAMES, cuts).fitted(42, **params)
        for rows in (folded.orderBy("key").coalesce(1), folded.orderBy(F.desc("f1")).repartition(3))
    )
    assert one.depth == other.depth == 6
    assert sorted(one.nodes.fillna(0.0).collect()) == sorted(other.nodes.fillna(0.0).collect())


@pytest.mark.parametrize("balance", ["smote", "weight"])
def test_more_rows_than_a_task_holds_are_fitted_by_the_library(spark, monkeypatch, balance):
    pdf, df = _planted(spark)
    monkeypatch.setattr(forest, "HELD_ROWS", 100)
    held = forest.train_forest(df, NAMES, ["key"], n_iter=1, depths=(4,), trees=(8, 8), balance=balance)
    assert held.cv_auc > 0.9 and held.auc.first()["auc"] > 0.9
    sizes = df.join(stratified_split(df, ["key"]).where("not is_test").select("key"), "key").groupBy("target").count().collect()
    fitted = 2 * max(r["count"] for r in sizes) if balance == "smote" else sum(r["count"] for r in sizes)
    assert held.areas.agg(F.sum(F.col("positives") + F.col("negatives"))).first()[0] == fitted
    # Its bounds are values of the features again, and the nodes are walked as those of any forest.
    inner = held.model.nodes.where("left >= 0").collect()
    assert inner and held.model.nodes.where("left < 0 AND bound IS NOT NULL").count() == 0
    if balance == "weight":
        values = {(i, float(v)) for i, f in enumerate(NAMES) for v in pdf[f]}
        assert {(r.feature, r.bound) for r in inner} <= values


def test_a_row_without_a_feature_is_refused(spark):
    _, df = _planted(spark, 60)
    cuts = forest.feature_cuts(df, NAMES)
    rows = df.withColumn("_fold", F.lit(0)).withColumn("f1", F.when(F.col("key") != "k7", F.col("f1")))
    with pytest.raises(Exception, match="lacks a feature"):
        forest.Held.of(rows, NAMES, cuts)
