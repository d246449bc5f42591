"""The learned queries on the smallest tables, against plain Python: the search over the whole space is made once."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import forest
from quantloom.operators import sequences as seq
from quantloom.operators.blend import WEIGHTS
from quantloom.plans import catalog
from quantloom.plans.catalog import QUERIES, Inputs
from quantloom.sources import readers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def searched(spark):
    return catalog.searched(Inputs(spark, SMALL))


def test_search_covers_the_whole_space(spark, searched):
    rows = QUERIES["forest_search"](spark, SMALL).collect()
    assert sorted((r.draw, r.fold) for r in rows) == [(d, f) for d in range(forest.DRAWS) for f in range(forest.FOLDS)]
    assert all(100 <= r.trees <= 499 and r.max_depth in forest.DEPTHS and 0.5 < r.auc < 1 for r in rows)
    trained, _ = searched
    means = {d: sum(r.auc for r in rows if r.draw == d) / forest.FOLDS for d in range(forest.DRAWS)}
    assert trained.cv_auc == pytest.approx(max(means.values())) and trained.params == forest.draw_params()[max(means, key=means.get)]
    report = {r["class"]: r for r in QUERIES["forest_holdout"](spark, SMALL).collect()}
    held = trained.holdout.toPandas()
    assert report["accuracy"].support == len(held)
    assert report["accuracy"].f1 == pytest.approx((held.target == held.prediction).mean())
    up, down = held[held.target == 1].ml_pred_proba.to_numpy(), held[held.target == 0].ml_pred_proba.to_numpy()
    area = (up[:, None] > down[None]).mean() + (up[:, None] == down[None]).mean() / 2
    assert report["0"].auc == pytest.approx(area, abs=1e-9) and area > 0.6


def test_scores_and_ranking_by_hand(spark, searched):
    inputs = Inputs(spark, SMALL)
    model = forest.load_model(searched[1])
    trees: dict = {}
    for node in model.nodes.collect():
        trees.setdefault(node.tree, {})[node.node] = node
    want = {}
    for row in inputs.universe[0].collect():
        total = 0.0
        for tree in trees.values():
            at = tree[0]
            while at.left >= 0:
                at = tree[at.left if row[model.features[at.feature]] <= at.bound else at.right]
            total += at.share
        want[row.ticker] = total / len(trees)
    got = {r.ticker: r.ml_pred_proba for r in QUERIES["ml_score"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(got[t] == pytest.approx(p, abs=1e-9) for t, p in want.items())
    blends = {
        r.ticker: sum(weight * (want[r.ticker] if name == "ml_pred_proba" else r[name] or 0) for name, weight in WEIGHTS.items() if weight and (name in r or name == "ml_pred_proba"))
        for r in inputs.scored.collect()
    }
    low, high = min(blends.values()), max(blends.values())
    ranked = QUERIES["ml_ranking"](spark, SMALL).collect()
    for r in ranked:
        assert r.final_score == pytest.approx(100 * (blends[r.ticker] - low) / (high - low), abs=0.006)
    order = sorted(blends, key=lambda t: (-round(blends[t], 9), t))
    assert [r.ticker for r in sorted(ranked, key=lambda r: r.final_rank)] == order


def _forward(weights: np.ndarray, x: np.ndarray, layers=(60, 25, 2)) -> np.ndarray:
    """Probabilities of a feed-forward net: logistic hidden units, soft maximum at the end."""
    at = 0
    for k, (n_in, n_out) in enumerate(zip(layers, layers[1:])):
        matrix = weights[at : at + n_in * n_out].reshape(n_in, n_out)
        bias = weights[at + n_in * n_out : at + n_in * n_out + n_out]
        at += n_in * n_out + n_out
        x = x @ matrix + bias
        x = 1 / (1 + np.exp(-x)) if k < len(layers) - 2 else np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def test_trend_scores_by_hand(spark):
    inputs = Inputs(spark, SMALL)
    model, placed = catalog.trend_model(inputs)
    weights = np.array(model.weights)
    newest = {r.ticker: r.sequence for r in seq.newest_sequences(inputs.bars_since(readers.TRAIN_DAYS)).collect()}
    got = {r.ticker: r.dl_trend_score for r in QUERIES["dl_trend_score"](spark, SMALL).collect()}
    up = _forward(weights, np.array(list(newest.values())))[:, 1]
    assert set(got) == set(newest) and all(got[t] == pytest.approx(100 * p, abs=0.006) for t, p in zip(newest, up, strict=True))
    tail = placed.where("is_tail").toPandas()
    right = ((_forward(weights, np.array(tail.sequence.tolist()))[:, 1] > 0.5).astype(int) == tail.target).mean()
    row = QUERIES["trend_accuracy"](spark, SMALL).first()
    assert (row.samples, row.accuracy) == (len(tail), pytest.approx(right))


def test_a_planted_trend_is_learned(spark):
    """Series that swing: the last 60 closes tell whether the close 20 rows later is higher."""
    day = dt.date(2020, 1, 1)
    rows = [(f"T{k}", day + dt.timedelta(days=i), 100 + 10 * math.sin(i / (9 + k) + k)) for k in range(4) for i in range(500)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    placed = seq.tail_split(seq.labelled(seq.sequences(bars)))
    model = seq.train_sequence_model(placed.where(~F.col("is_tail")), epochs=60)
    found = seq.sequence_accuracy(model, placed.where("is_tail")).first()
    assert found.samples > 150 and found.accuracy > 0.9
