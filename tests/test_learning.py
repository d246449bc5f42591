import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import forest, metrics, neighbours, sampling
from quantloom.operators import sequences as seq
from quantloom.operators.neighbours import nearest

FEATURES = ["f0", "f1", "f2"]


def _rows(spark, n=3_000, seed=4, copies=0.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=FEATURES)
    pdf["target"] = (pdf["f0"] + 0.5 * rng.normal(size=n) > 1.0).astype("int32")
    if copies:
        same = (pdf["target"] == 1) & (rng.random(n) < copies)
        pdf.loc[same, FEATURES] = [2.0, 0.0, 0.0]
    pdf["key"] = [f"k{i}" for i in range(n)]
    return pdf, spark.createDataFrame(pdf)


def test_split_is_exact_and_repeatable(spark):
    pdf, df = _rows(spark)
    parts = sampling.stratified_split(df, ["key"])
    again = sampling.stratified_split(df.repartition(3), ["key"])
    for value, n in pdf["target"].value_counts().items():
        assert parts.where((F.col("target") == value) & F.col("is_test")).count() == int(np.floor(0.3 * n + 0.5))
    assert parts.count() == len(pdf)
    assert parts.select("key", "is_test").exceptAll(again.select("key", "is_test")).count() == 0


def test_time_split_holds_out_the_last_dates(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i % 100), 0) for i in range(1_000)]
    parts = sampling.time_split(spark.createDataFrame(rows, "date date, target int"))
    test, train = parts.where("is_test"), parts.where("not is_test")
    assert test.count() == 300 and test.agg(F.min("date")).first()[0] > train.agg(F.max("date")).first()[0]


class _Counted(list):
    """A list that counts how often an element is read."""

    reads = 0

    def __getitem__(self, at):
        self.reads += 1
        return super().__getitem__(at)


def test_cells_in_reach_are_found_without_comparing_all():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=20_000), np.exp(2 * rng.normal(size=20_000)), rng.integers(0, 3, 20_000)])
    nodes = neighbours._cut_space(x[:5_000], 1_000)
    cell = neighbours._cell_of(nodes, x)
    names = np.unique(cell[cell != 7])  # one cell stays empty
    low, high = (np.array([f(x[cell == c], axis=0) for c in names]) for f in (np.min, np.max))
    lows, highs = neighbours._boxes_of(nodes, names, low, high)
    points, radius = x[:300], np.concatenate([[np.inf], np.full(299, 0.01)])
    gap = (np.maximum(0, np.maximum(low - points[:, None], points[:, None] - high)) ** 2).sum(axis=2)
    want = {(r, int(names[c])) for r, c in zip(*np.nonzero(gap <= radius[:, None]), strict=True)}
    assert set(zip(*(v.tolist() for v in neighbours._reached(nodes, lows, highs, points, radius)), strict=True)) == want
    counted = _Counted(nodes)
    row, _ = neighbours._reached(counted, lows, highs, points[1:2], radius[1:2])
    assert 0 < len(row) <= counted.reads < len(names) / 5


@pytest.mark.parametrize("cell_rows", [10_000, 60])
def test_neighbours_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 3)) * [1.0, 10.0, 0.1]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, x array<double>, copies long")
    got = nearest(df, 5, cell_rows).select("id", F.transform("near", lambda n: n["near_id"]).alias("ids")).collect()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert len(got) == len(x)
    for row in got:
        assert row["ids"] == list(want[row["id"]])


@pytest.mark.parametrize("copies", [0.0, 0.5])
def test_smote_balances_on_segments(spark, copies):
    pdf, df = _rows(spark, 1_200, copies=copies)
    out = sampling.smote(df, FEATURES, ["key"]).toPandas()
    assert out["target"].value_counts().nunique() == 1
    assert len(out[~out["synthetic"]]) == len(pdf)
    minor = pdf.loc[pdf["target"] == 1, FEATURES].to_numpy()
    made = out.loc[out["synthetic"], FEATURES].to_numpy()
    distinct, count = np.unique(minor, axis=0, return_counts=True)
    d = np.sqrt(((distinct[:, None] - distinct[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    ends = []
    for i in range(len(distinct)):
        found, room = [i] if count[i] > 1 else [], 5 - min(count[i] - 1, 5)
        for j in np.argsort(d[i]):
            if room <= 0 or not np.isfinite(d[i, j]):
                break
            found.append(j)
            room -= count[j]
        ends += [(distinct[i], distinct[j]) for j in found]
    a, b = (np.array(e) for e in zip(*ends))
    along = b - a
    length = np.maximum((along**2).sum(axis=1), 1e-300)
    for p in made:
        t = np.clip(((p - a) * along).sum(axis=1) / length, 0, 1)
        assert np.abs(a + t[:, None] * along - p).max(axis=1).min() < 1e-9


def test_smote_leaves_balanced_rows_alone(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1)], "key string, f double, target int")
    assert sampling.smote(df, ["f"], ["key"]).count() == 2


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "target int")
    sums = sampling.class_weights(df).groupBy("target").agg(F.sum("weight").alias("w")).collect()
    assert {r["w"] for r in sums} == {2.0}


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 15, 400) / 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "target int, score double")
    up, down = s[y == 1], s[y == 0]
    want = ((up[:, None] > down[None]).mean() + (up[:, None] == down[None]).mean() / 2)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    df = spark.createDataFrame(pairs, "target int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in metrics.classification_report(df).collect()}
    assert got["0"] == pytest.approx((5 / 7, 5 / 6, 10 / 13, 6))
    assert got["1"] == pytest.approx((2 / 3, 1 / 2, 4 / 7, 4))
    assert got["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert got["macro avg"][0] == pytest.approx((5 / 7 + 2 / 3) / 2)
    assert got["weighted avg"][2] == pytest.approx((10 / 13 * 6 + 4 / 7 * 4) / 10)


def test_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "target int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in metrics.classification_report(df).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1)


def _pair_count(y, s):
    up, down = s[y == 1], s[y == 0]
    return (up[:, None] > down[None]).mean() + (up[:, None] == down[None]).mean() / 2


def _walk(nodes, x):
    """Mean leaf share over the trees of {tree: {node: row}}, in plain Python."""
    total = 0.0
    for tree in nodes.values():
        at = tree[0]
        while at.left >= 0:
            at = tree[at.left if x[at.feature] <= at.bound else at.right]
        total += at.share
    return total / len(nodes)


def _trees(model):
    out = {}
    for row in model.nodes.collect():
        out.setdefault(row.tree, {})[row.node] = row
    return out


@pytest.mark.parametrize("balance", ["smote", "weight"])
def test_forest_finds_a_planted_signal(spark, tmp_path, balance):
    pdf, df = _rows(spark, 1_500)
    trained = forest.train_forest(
        df, FEATURES, ["key"], n_iter=2, depths=(3, 5), trees=(5, 8), parallelism=2, balance=balance
    )
    assert trained.cv_auc > 0.9 and trained.auc.first()["auc"] > 0.9
    assert trained.report.where("class = 'accuracy'").first()["support"] == trained.holdout.count()
    assert sorted((r.draw, r.fold) for r in trained.areas.collect()) == [(d, f) for d in range(2) for f in range(3)]
    held = trained.holdout.toPandas()
    assert trained.auc.first()["auc"] == pytest.approx(_pair_count(held.target.to_numpy(), held.ml_pred_proba.to_numpy()), abs=1e-12)
    path = str(tmp_path / "model")
    version = forest.save_model(trained.model, path)
    loaded = forest.load_model(path)
    assert loaded.features == FEATURES and loaded.depth == trained.model.depth
    instruments = df.withColumnRenamed("key", "ticker")
    scored = {r.ticker: r.ml_pred_proba for r in forest.score_instruments(loaded, instruments).collect()}
    trees = _trees(trained.model)
    for row in pdf.itertuples():
        assert scored[row.key] == pytest.approx(_walk(trees, [row.f0, row.f1, row.f2]), abs=1e-9)
    short = forest.score_instruments(loaded, instruments.drop("f1"))
    assert {r["ml_pred_proba"] for r in short.collect()} == {0.0}
    # A second version wins; the first can still be named; a version without a marker doesn't exist.
    other = forest.Forest(trained.model.nodes.where("tree = 0"), FEATURES, trained.model.depth)
    forest.save_model(other, path)
    trained.model.nodes.write.parquet(f"{path}/00000009-left-halfway/nodes")
    assert forest.load_model(path).nodes.select("tree").distinct().count() == 1
    assert forest.load_model(path, version).nodes.count() == trained.model.nodes.count()


def test_walk_equals_the_fitted_model(spark):
    from pyspark.ml.functions import vector_to_array

    _, df = _rows(spark, 800)
    rows = forest._assembled(df, FEATURES)
    fitted = forest._classifier("target", 5, {"numTrees": 12, "maxDepth": 7}).fit(rows)
    want = fitted.transform(rows).select("key", vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("c")).collect()
    got = {r.key: r for r in forest.predict(forest.forest_of(fitted, FEATURES), df, ["key"]).collect()}
    for row in want:
        assert got[row.key].ml_pred_proba == pytest.approx(row.p, abs=1e-12) and got[row.key].prediction == row.c


def test_a_fit_wraps_no_tree_in_python(spark, monkeypatch):
    from pyspark.ml import classification

    class Counted(classification.DecisionTreeClassificationModel):
        made = 0

        def __init__(self, *args):
            Counted.made += 1
            super().__init__(*args)

    monkeypatch.setattr(classification, "DecisionTreeClassificationModel", Counted)
    rows = forest._assembled(_rows(spark, 300)[1], FEATURES).coalesce(1)
    params = {"numTrees": 9, "maxDepth": 4}
    fitted = forest._classifier("target", 5, params).fit(rows)
    stored = forest.forest_of(fitted, FEATURES)
    assert fitted.transform(rows).count() == 300 and Counted.made == 0
    assert len(fitted.trees) == 9 and Counted.made == 9
    assert stored.depth == max(t.depth for t in fitted.trees)
    # Where the rows of a small training part are is kept; a large one's trees travel instead. Both give the same forest.
    plain = forest._classifier("target", 5, params, tasks=2)
    assert fitted.getCacheNodeIds() and not plain.getCacheNodeIds()
    assert plain.fit(rows).toDebugString.splitlines()[1:] == fitted.toDebugString.splitlines()[1:]


def test_walk_takes_no_forest_along_with_the_rows(spark):
    """Rows meet the forest as arrays in the task; a missing value goes right, an equal one left."""
    nodes = [(0, 0, 0, 1.0, 1, 2, 0.5), (0, 1, -1, None, -1, -1, 0.25), (0, 2, 1, -2.0, 3, 4, 0.5), (0, 3, -1, None, -1, -1, 0.0), (0, 4, -1, None, -1, -1, 1.0), (1, 0, -1, None, -1, -1, 0.5)]
    model = forest.Forest(spark.createDataFrame(nodes, forest._NODES), ["a", "b"], 2)
    rows = [(1, 1.0, 0.0), (2, 1.5, -2.0), (3, 1.5, None), (4, None, -3.0), (5, None, None), (6, float("nan"), -1.0)]
    scored = forest.predict(model, spark.createDataFrame(rows, "key int, a double, b double"), ["key"])
    assert {r.key: r.ml_pred_proba for r in scored.collect()} == {1: 0.375, 2: 0.25, 3: 0.75, 4: 0.25, 5: 0.75, 6: 0.75}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "lambda" not in plan


class _Taken(np.ndarray):
    """An array that may not be indexed by an array, only taken from."""

    def __getitem__(self, at):
        assert not isinstance(at, np.ndarray)
        return super().__getitem__(at)


def test_walk_takes_from_the_nodes_and_ends_at_each_leaf():
    kinds = {"feature": np.int32, "bound": float, "left": np.int32, "right": np.int32, "share": float}
    columns = [[0, -1, 1, -1, -1], [1.0, np.nan, -2.0, np.nan, np.nan], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.5, 0.25, 0.5, 0.0, 1.0]]
    tree = {c: np.array(v, dtype=k).view(_Taken) for (c, k), v in zip(kinds.items(), columns, strict=True)}
    lone = {c: np.array(v[1:2], dtype=k).view(_Taken) for (c, k), v in zip(kinds.items(), columns, strict=True)}
    nan = np.nan
    x = np.array([[1.0, 0.0], [1.5, -2.0], [1.5, nan], [nan, -3.0], [nan, nan], [2.0, 5.0]])
    for order in "CF":
        assert forest._shares([tree], np.asarray(x, order=order)).tolist() == [0.25, 0.0, 1.0, 0.0, 1.0, 1.0]
    assert forest._shares([tree, lone], x[:2]).tolist() == [0.25, 0.125] and len(forest._shares([tree], x[:0])) == 0


def test_areas_of_groups_equal_pair_counting(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"draw": rng.integers(0, 3, 900), "fold": rng.integers(0, 2, 900), "target": rng.integers(0, 2, 900), "score": rng.integers(0, 40, 900) / 7})
    pdf.loc[(pdf.draw == 2) & (pdf.fold == 1), "target"] = 1
    got = {(r.draw, r.fold): r.auc for r in metrics.roc_areas(spark.createDataFrame(pdf), ["draw", "fold"]).collect()}
    assert len(got) == 6 and got.pop((2, 1)) is None
    for (d, f), area in got.items():
        part = pdf[(pdf.draw == d) & (pdf.fold == f)]
        assert area == pytest.approx(_pair_count(part.target.to_numpy(), part.score.to_numpy()), abs=1e-12)


def test_missing_model_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        forest.load_model(str(tmp_path / "none"))


def test_draws_are_seeded_and_in_range():
    draws = forest.draw_params(20)
    assert draws == forest.draw_params(20) != forest.draw_params(20, seed=1)
    assert all(100 <= d["numTrees"] <= 499 and d["maxDepth"] in (10, 20, 30) and 1 <= d["minInstancesPerNode"] <= 19 for d in draws)


def test_sequences_and_trend(spark):
    day = dt.date(2020, 1, 1)
    rows = []
    for ticker, n in (("UP", 100), ("SHORT", 79), ("WAVE", 140)):
        for i in range(n):
            close = 100.0 + i if ticker != "WAVE" else 100.0 + 10 * np.sin(i / 6)
            rows.append((ticker, day + dt.timedelta(days=i), float(close)))
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    all_sequences = seq.sequences(bars)
    samples = seq.labelled(all_sequences)
    got = {r["ticker"]: r["count"] for r in samples.groupBy("ticker").count().collect()}
    assert got == {"UP": 21, "WAVE": 61}
    first = samples.where("ticker = 'UP'").orderBy("date").first()
    np.testing.assert_allclose(first["sequence"], np.arange(60) / 99)
    assert first["target"] == 1
    split = seq.tail_split(samples)
    assert split.where("is_tail").count() == 82 - int(82 * 0.9)
    assert {r["ticker"] for r in split.where("is_tail").collect()} == {"WAVE"}
    model = seq.train_sequence_model(samples, epochs=5)
    scores = {r["ticker"]: r["dl_trend_score"] for r in seq.trend_scores(model, seq.newest_sequences(bars)).collect()}
    assert set(scores) == {"UP", "WAVE", "SHORT"} and all(0 <= s <= 100 for s in scores.values())


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(float(i % 7), int(i % 10 == 0)) for i in range(600)], "x double, target int")
    sizes = {tuple(r)[:2]: r["count"] for r in forest.stratified_folds(rows, ["x"]).groupBy("target", "_fold").count().collect()}
    assert sizes == {(t, f): n for t, n in ((0, 180), (1, 20)) for f in range(3)}


def test_newest_sequences_are_the_last_of_all(spark):
    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(days=i), float((i * 7) % 31)) for t, n in (("A", 90), ("B", 60), ("C", 59)) for i in range(n)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = {r["ticker"]: r["sequence"] for r in seq.newest_sequences(bars).collect()}
    every = seq.sequences(bars).where("sequence IS NOT NULL").orderBy("date").collect()
    assert got == {r["ticker"]: r["sequence"] for r in every} and set(got) == {"A", "B"}
