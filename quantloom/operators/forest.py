"""Random-forest classifier: search, training, storage and scoring.

Every training row is fitted on. The features are cut into bins at exact quantiles of all rows; from there each tree is
grown by numpy in one task that holds the rows as bytes, or, where the rows are too many for a task, by the learning
library, which spreads the rows. A fitted forest is a table of nodes (tree, node, feature, bound, left, right, share).
It is stored and loaded as that, and walked by numpy in Arrow batches, some trees after the others if they are many.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import model_store
from quantloom.operators.metrics import classification_report, roc_areas, roc_auc
from quantloom.operators.order import row_positions, value_counts
from quantloom.operators.sampling import SEED, class_weights, smote, stratified_split, time_split
from quantloom.operators.trees import BINS, binned, grown
from quantloom.storage import discard, materialise, new_path

# The walk travels with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Search space and folds.
TREES = (100, 499)
LEAF_ROWS = (1, 19)
DEPTHS = (10, 20, 30)
DRAWS = 10
FOLDS = 3
# Rows that a task holds to grow whole trees on: some 12 bytes each, and 80 more while a tree grows. More rows are fitted
# by the learning library, which spreads them; none are left out.
HELD_ROWS = 8_000_000
# Trees that a task of the search grows, and one of the refit: the first returns a sum for each held-out row, the second nodes.
SEARCH_TREES = 100
FIT_TREES = 16
# Nodes that are sent to the tasks at once; a larger forest is walked some trees after the others.
WALK_NODES = 8_000_000
# Rows of one task in a fit by the library: each level of all trees is a job, so a small training part wants few tasks.
TASK_ROWS = 65_536


_NODES = "tree int, node int, feature int, bound double, left int, right int, share double"
_NAMES = ["tree", "node", "feature", "bound", "left", "right", "share", "level"]
_ABOUT = "features array<string>, depth int"


@dataclass
class Forest:
    """Nodes of all trees, the features by number, and the deepest level."""

    nodes: DataFrame
    features: list[str]
    depth: int
    _trees: dict[tuple[int, int], list[dict[str, np.ndarray]]] = field(default_factory=dict, repr=False)
    _groups: list[tuple[int, int]] | None = field(default=None, repr=False)

    def groups(self) -> list[tuple[int, int]]:
        """First and last tree of each group with at most `WALK_NODES` nodes (a tree more than that is its own group)."""
        if self._groups is None:
            sizes = sorted((r["tree"], r["nodes"]) for r in self.nodes.groupBy("tree").agg(F.count("*").alias("nodes")).collect())
            groups, held = [], 0
            for tree, nodes in sizes:  # one number for each tree
                if groups and held + nodes <= WALK_NODES:
                    groups[-1], held = (groups[-1][0], tree), held + nodes
                else:
                    groups, held = [*groups, (tree, tree)], nodes
            self._groups = groups
        return self._groups

    def trees(self, group: tuple[int, int]) -> list[dict[str, np.ndarray]]:
        """For each tree of a group its nodes as arrays, a node's number being its place."""
        if group not in self._trees:
            kinds = {"feature": np.int32, "bound": float, "left": np.int32, "right": np.int32, "share": float}
            table = self.nodes.where(F.col("tree").between(*group)).select("tree", "node", *kinds).toArrow()
            columns = {c: table[c].to_numpy() for c in table.column_names}
            order = np.lexsort((columns["node"], columns["tree"]))
            starts = np.flatnonzero(np.diff(columns["tree"][order], prepend=-1))
            parts = {c: np.split(columns[c][order].astype(k), starts[1:]) for c, k in kinds.items()}
            self._trees = {group: [dict(zip(parts, t, strict=True)) for t in zip(*parts.values(), strict=True)]}
        return self._trees[group]


@dataclass
class Trained:
    """The refitted best model, the areas of the search, and the hold-out results."""

    model: Forest
    cv_auc: float
    params: dict[str, int]
    areas: DataFrame
    holdout: DataFrame
    auc: DataFrame
    report: DataFrame


def draw_params(
    n_iter: int = DRAWS,
    depths: Sequence[int] = DEPTHS,
    trees: tuple[int, int] = TREES,
    seed: int = SEED,
) -> list[dict[str, int]]:
    """Seeded random draws. A minimum split size has no counterpart here and is not drawn."""
    rng = random.Random(seed)
    return [
        {
            "numTrees": rng.randint(*trees),
            "maxDepth": rng.choice(list(depths)),
            "minInstancesPerNode": rng.randint(*LEAF_ROWS),
        }
        for _ in range(n_iter)
    ]


def balanced(
    train: DataFrame, features: Sequence[str], key: Sequence[str], balance: str = "smote", label: str = "target"
) -> DataFrame:
    """Training rows with equal classes (`smote`), equal class weights (`weight`), or as they are (`none`)."""
    if balance == "smote":
        return smote(train, features, key, label)
    if balance == "weight":
        return class_weights(train, label)
    return train


def stratified_folds(rows: DataFrame, features: Sequence[str], label: str = "target", folds: int = FOLDS) -> DataFrame:
    """Add `_fold`: rows are dealt out in turn, class by class, in the order of a hash; repeated rows are spread."""
    placed = row_positions(rows.withColumn("_draw", F.xxhash64(*features)), [label, "_draw", *features], "_place")
    return placed.withColumn("_fold", (F.col("_place") % folds).cast("int")).drop("_draw", "_place")


def _assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def _tasks(train: DataFrame) -> int:
    return -(-train.count() // TASK_ROWS) or 1


class _Fitted(RandomForestClassificationModel):
    """A fitted forest whose trees are wrapped in Python only when asked for.

    The library's class has them as a cached property, which it reads whenever it lists the parameters, so for each fit:
    several calls for each of hundreds of trees, in the one process that all fits of a search share.
    """

    @property
    def trees(self) -> list[DecisionTreeClassificationModel]:
        return RandomForestClassificationModel.trees.func(self)


class _Classifier(RandomForestClassifier):
    def _create_model(self, java_model) -> _Fitted:
        return _Fitted(java_model)


def _classifier(label: str, seed: int, params: dict, tasks: int = 1) -> RandomForestClassifier:
    # A small training part keeps the node that each row is at, in each tree; else each level sends all trees to the tasks.
    settings = {"featureSubsetStrategy": "sqrt", "seed": seed, "cacheNodeIds": tasks == 1}
    return _Classifier(labelCol=label, featuresCol="features", **settings, **params)


def feature_cuts(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values that end a bin: all but the largest if they are few, else exact quantiles of all rows."""
    values = value_counts(train, features)
    whole = values.groupBy("metric").agg(F.sum("rows").alias("_n"), F.count("*").alias("_values"))
    upto = F.col("rows_before") + F.col("rows")
    ends = F.expr(f"(rows_before + rows) * {bins} div _n > rows_before * {bins} div _n") | (F.col("_values") <= bins)
    kept = values.join(F.broadcast(whole), "metric").where(ends & (upto < F.col("_n"))).select("metric", "value").collect()
    return [np.array(sorted(r["value"] for r in kept if r["metric"] == f)) for f in features]  # less than `bins` for each


def _bytes_of(cuts: Sequence[np.ndarray]):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.isnull().to_numpy().any():
                raise ValueError("a training row lacks a feature, its label or its weight")
            values = batch.to_numpy(dtype=float)
            x, y, fold, *weight = values[:, : len(cuts)], *values[:, len(cuts) :].T
            parts = binned(x, cuts), y.astype(np.uint8), fold.astype(np.uint8), np.array(weight)
            yield pd.DataFrame([[p.tobytes() for p in parts]], columns=["x", "y", "fold", "weight"])

    return pack


@dataclass
class Held:
    """The training rows as tasks hold them to grow whole trees: (bytes of the features, class, fold, weight or None)."""

    features: list[str]
    cuts: list[np.ndarray]
    rows: Broadcast

    @staticmethod
    def of(train: DataFrame, features: Sequence[str], cuts: list[np.ndarray], label: str = "target", weightCol: str | None = None) -> Held:
        columns = [*features, label, "_fold", *([weightCol] if weightCol else [])]
        plain = train.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
        # Some bytes for each row, of at most HELD_ROWS.
        parts = plain.mapInPandas(_bytes_of(cuts), "x binary, y binary, fold binary, weight binary").collect()
        whole = lambda name, kind: np.frombuffer(b"".join(p[name] for p in parts), dtype=kind)
        x, y, fold, weight = whole("x", np.uint8).reshape(-1, len(cuts)), whole("y", np.uint8), whole("fold", np.uint8), whole("weight", float)
        if not len(y):
            raise ValueError("there are no rows to fit on")
        # Rows of equal bytes are the same to a tree, so a forest does not depend on the order that the rows come in.
        order = np.lexsort([*([weight] if weightCol else []), fold, y, *x.T])
        rows = (x[order], y[order], fold[order], weight[order] if weightCol else None)
        return Held(list(features), cuts, train.sparkSession.sparkContext.broadcast(rows))

    def out_of_fold(self, draws: Sequence[dict[str, int]], folds: int, seed: int) -> DataFrame:
        """(draw, fold, place, label, total): sums over some trees of the shares at the held-out rows."""
        held = self.rows
        work = [(k, f, *part) for k, d in enumerate(draws) for f in range(folds) for part in _parts(d["numTrees"], SEARCH_TREES)]
        work.sort(key=lambda w: (w[2] - w[3]) * draws[w[0]]["maxDepth"])  # long tasks first

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, fold, weight = held.value
            for at in (at for batch in batches for at in batch["id"]):
                draw, own, begin, end = work[at]
                out = np.flatnonzero(fold == own)
                rest = np.flatnonzero(fold != own)
                if not len(rest):
                    raise ValueError("there are no rows to fit on")
                mine = (x[rest], y[rest], None if weight is None else weight[rest])
                seen, total = x[out], np.zeros(len(out))
                for tree in range(begin, end):
                    total += _shares([grown(*mine, seed, tree, draws[draw]["maxDepth"], draws[draw]["minInstancesPerNode"])], seen)
                yield pd.DataFrame({"draw": draw, "fold": own, "place": out, "label": y[out], "total": total})

        return _one_task_each(work).mapInPandas(judge, "draw int, fold int, place long, label int, total double")

    def areas(self, draws: Sequence[dict[str, int]], folds: int, label: str, seed: int) -> DataFrame:
        """(draw, fold, positives, negatives, auc), as `search_areas`."""
        sums = materialise(self.out_of_fold(draws, folds, seed), "out-of-fold")
        mean = F.sum("total") / F.first(F.element_at(F.lit([d["numTrees"] for d in draws]), F.col("draw") + 1))
        # Rounded, for equal scores must stay equal however their parts are added.
        scored = sums.groupBy("draw", "fold", "place").agg(F.first("label").alias(label), F.round(mean, 12).alias("score"))
        return roc_areas(scored, ["draw", "fold"], label)

    def fitted(self, seed: int, numTrees: int, maxDepth: int, minInstancesPerNode: int) -> Forest:
        held, cuts = self.rows, self.cuts
        work = _parts(numTrees, FIT_TREES)

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, _, weight = held.value
            table = np.full((len(cuts), BINS), np.nan)
            for i, c in enumerate(cuts):
                table[i, : len(c)] = c
            for tree in (t for batch in batches for at in batch["id"] for t in range(*work[at])):
                nodes = grown(x, y, weight, seed, tree, maxDepth, minInstancesPerNode)
                bound = np.where(nodes["feature"] < 0, np.nan, table[nodes["feature"], nodes["bound"]])
                yield pd.DataFrame({"tree": tree, "node": np.arange(len(bound)), **nodes, "bound": bound})

        schema = f"{_NODES}, level int"
        nodes = _one_task_each(work).mapInPandas(lambda b: (t[_NAMES] for t in grow(b)), schema)
        stored = materialise(nodes, "nodes")
        depth = stored.agg(F.max("level")).first()[0]
        return Forest(stored.drop("level"), self.features, depth)


def _one_task_each(work: Sequence[tuple]) -> DataFrame:
    return SparkSession.getActiveSession().range(0, len(work), 1, len(work))


def _parts(trees: int, size: int) -> list[tuple[int, int]]:
    return [(at, min(at + size, trees)) for at in range(0, trees, size)]


def search_areas(
    train: DataFrame,
    features: Sequence[str],
    draws: Sequence[dict[str, int]],
    label: str = "target",
    folds: int = FOLDS,
    parallelism: int = 4,
    seed: int = SEED,
    **fixed: str,
) -> DataFrame:
    """(draw, fold, positives, negatives, auc): each draw fitted by the library without one fold and judged on it.

    The out-of-fold predictions of all draws go into one long table; all areas come from one grouped pass over it.
    """
    columns = [label, "_fold", *fixed.values()]
    tasks = _tasks(train)
    rows = _assembled(train, features).select("features", *columns).coalesce(tasks)
    path = new_path(train.sparkSession, "out-of-fold")

    def judge(draw: int, fold: int) -> None:
        model = _classifier(label, seed, draws[draw] | fixed, tasks).fit(rows.where(F.col("_fold") != fold))
        scored = model.transform(rows.where(F.col("_fold") == fold))
        scored.select(label, vector_to_array("probability")[1].alias("score")).write.parquet(f"{path}/draw={draw}/fold={fold}")

    with ThreadPoolExecutor(parallelism) as pool:
        for done in [pool.submit(judge, d, f) for d in range(len(draws)) for f in range(folds)]:
            done.result()
    kind = train.schema[label].dataType.simpleString()
    long = train.sparkSession.read.schema(f"`{label}` {kind}, score double, draw int, fold int").parquet(path)
    return roc_areas(long, ["draw", "fold"], label)


def in_bins(train: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Each feature as the number of its bin: the library then splits between the cuts, not at values of a sample of its own."""
    number = lambda f, c: sum([(F.col(f) > F.lit(float(v))).cast("double") for v in c], F.lit(0.0))
    return train.withColumns({f: number(f, c) for f, c in zip(features, cuts, strict=True)})


def out_of_bins(forest: Forest, cuts: Sequence[np.ndarray]) -> Forest:
    """The forest fitted on bins, for the values themselves: a bound between two bins is the cut that ends the lower one."""
    ends = F.lit([[float(v) for v in c] or [0.0] for c in cuts])
    bound = F.when(F.col("feature") >= 0, F.get(F.get(ends, F.col("feature")), F.floor("bound").cast("int")))
    return Forest(forest.nodes.withColumn("bound", bound), forest.features, forest.depth)


def train_forest(
    rows: DataFrame,
    features: Sequence[str],
    key: Sequence[str] = ("ticker", "date"),
    label: str = "target",
    n_iter: int = DRAWS,
    depths: Sequence[int] = DEPTHS,
    trees: tuple[int, int] = TREES,
    folds: int = FOLDS,
    parallelism: int = 4,
    split: str = "stratified",
    balance: str = "smote",
    seed: int = SEED,
) -> Trained:
    """Split, balance the training part, search by cross-validated AUC, refit, evaluate on the held-out part.

    Balancing comes before the folds, so synthetic rows leak between them, and the stratified split
    mixes overlapping windows; `split="time"` avoids the latter. The balanced part is stored once,
    since every fold and draw reads it. Every row of the training part is fitted on.
    """
    parts = materialise(
        time_split(rows, label) if split == "time" else stratified_split(rows, key, label, seed=seed), "split"
    )
    kept = balanced(parts.where(~F.col("is_test")), features, key, balance, label)
    train = materialise(stratified_folds(kept, features, label, folds), "train")

    fixed = {"weightCol": "weight"} if balance == "weight" else {}
    draws = draw_params(n_iter, depths, trees, seed)
    cuts = feature_cuts(train, features)
    held = Held.of(train, features, cuts, label, **fixed) if train.count() <= HELD_ROWS else None
    if held is None:
        train = materialise(in_bins(train, features, cuts), "train-in-bins")
    areas = held.areas(draws, folds, label, seed) if held else search_areas(train, features, draws, label, folds, parallelism, seed, **fixed)
    areas = materialise(areas, "areas")
    means = {r["draw"]: r["auc"] for r in areas.groupBy("draw").agg(F.avg("auc").alias("auc")).collect()}  # one row for each draw
    best = max(range(n_iter), key=lambda d: means.get(d) or 0.0)
    if held:
        model = held.fitted(seed, **draws[best])
        held.rows.destroy()
    else:
        model = out_of_bins(fit_forest(train, features, label, seed, **draws[best], **fixed), cuts)

    holdout = materialise(predict(model, parts.where(F.col("is_test")), [*key, label]), "holdout")
    return Trained(
        model=model,
        cv_auc=means.get(best) or 0.0,
        params=draws[best],
        areas=areas,
        holdout=holdout,
        auc=roc_auc(holdout, label, "ml_pred_proba"),
        report=classification_report(holdout, label, "prediction"),
    )


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "target", seed: int = SEED, **params) -> Forest:
    """One forest with the given parameters, fitted by the library, as a table."""
    tasks = _tasks(train)
    fitted = _classifier(label, seed, params, tasks).fit(_assembled(train, features).coalesce(tasks))
    return forest_of(fitted, features)


def forest_of(fitted: RandomForestClassificationModel, features: Sequence[str]) -> Forest:
    """The nodes of a fitted model, read from the table that it is written to."""
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "fitted")
    fitted.write().save(path)
    counts = F.col("nodeData.impurityStats")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("bound"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.coalesce(F.try_divide(F.get(counts, F.lit(1)), F.get(counts, F.lit(0)) + F.coalesce(F.get(counts, F.lit(1)), F.lit(0.0))), F.lit(0.0)).alias("share"),
    )
    forest = Forest(materialise(nodes, "nodes"), list(features), 0)
    forest.depth = max([0, *[_depth(tree) for group in forest.groups() for tree in forest.trees(group)]])
    return forest


def _depth(tree: dict[str, np.ndarray]) -> int:
    level, here = -1, np.zeros(1, dtype=np.int32)
    while len(here):
        inner = here[tree["left"][here] >= 0]
        level, here = level + 1, np.concatenate([tree["left"][inner], tree["right"][inner]])
    return level


def walked(forest: Forest, group: tuple[int, int], columns: Sequence[str]) -> Column:
    """Mean share of class 1 over the leaves of a group of trees that the row reaches; a missing value goes right.

    Arrays in Arrow batches: a level of a tree is one step for all rows of a batch that haven't met their leaf.
    """
    held = forest.nodes.sparkSession.sparkContext.broadcast(forest.trees(group))

    @F.pandas_udf("double")
    def share(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = held.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            yield pd.Series(_shares(trees, x))

    return share(*[F.col(c).cast("double") for c in columns])


def _shares(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    # `take` on numbers of the machine's own width; indexing by others converts and checks them at each step.
    total = np.zeros(len(x))
    flat = np.ascontiguousarray(x).ravel()
    starts = np.arange(len(x), dtype=np.intp) * x.shape[1]
    for t in trees:
        inner = t["left"] >= 0
        feature = np.where(inner, t["feature"], 0).astype(np.intp)
        children = np.column_stack([t["right"], t["left"]]).astype(np.intp).ravel()
        at = np.zeros(len(x), dtype=np.intp)
        rows = np.arange(len(x) if inner[0] else 0)
        here, start = at[rows], starts[rows]
        while len(rows):
            goes_left = flat.take(start + feature.take(here)) <= t["bound"].take(here)
            here = children.take(2 * here + goes_left)
            ends = ~inner.take(here)
            if ends.any():
                at[rows[ends]] = here[ends]
                left = np.flatnonzero(~ends)
                rows, here, start = rows.take(left), here.take(left), start.take(left)
        total += t["share"].take(at)
    return total / len(trees)


def predict(forest: Forest, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep.., ml_pred_proba, prediction): probability of class 1 and the class."""
    groups = forest.groups()
    if len(groups) == 1:
        scored = rows.select(*keep, walked(forest, groups[0], forest.features).alias("ml_pred_proba"))
    else:
        scored = _walked_in_turn(forest, rows, keep)
    return scored.withColumn("prediction", (F.col("ml_pred_proba") > 0.5).cast("int"))


def _walked_in_turn(forest: Forest, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The probability from one group of trees after the other, the sums stored in between: no task holds the whole forest."""
    names = [f"_x{i}" for i in range(len(forest.features))]
    sums = rows.select(*keep, *[F.col(f).cast("double").alias(n) for f, n in zip(forest.features, names, strict=True)], F.lit(0.0).alias("_sum"))
    every = 0
    for group in forest.groups():
        trees = len(forest.trees(group))
        walk = walked(forest, group, names)
        done = materialise(sums.withColumn("_sum", F.col("_sum") + walk * trees), "walk")
        if every:
            discard(sums)
        sums, every = done, every + trees
    return sums.select(*keep, (F.col("_sum") / every).alias("ml_pred_proba"))


def score_instruments(forest: Forest, universe: DataFrame) -> DataFrame:
    """(ticker, ml_pred_proba); 0.0 for all when the universe lacks a feature of the model."""
    if set(forest.features) - set(universe.columns):
        return universe.select("ticker", F.lit(0.0).alias("ml_pred_proba"))
    return predict(forest, universe, ["ticker"]).drop("prediction")


def save_model(forest: Forest, path: str) -> str:
    """Store the forest and its feature list as a new version, committed last; returns the version."""
    about = forest.nodes.sparkSession.createDataFrame([(forest.features, forest.depth)], _ABOUT)
    return model_store.save({"nodes": forest.nodes, "about": about}, path)


def load_model(path: str, version: str | None = None) -> Forest:
    """Load a stored forest, or say clearly that there is none."""
    tables = model_store.load(SparkSession.getActiveSession(), path, {"nodes": _NODES, "about": _ABOUT}, version)
    about = tables["about"].first()
    return Forest(tables["nodes"], list(about.features), about.depth)
