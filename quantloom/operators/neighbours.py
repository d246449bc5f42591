"""Exact nearest neighbours of a large table of distinct vectors.

Space is cut into cells by medians of a bounded sample. Round one searches every vector's own cell
and gives an upper bound on its search radius. Round two sends the vector to each further cell whose
bounding box lies within that radius, found from the root of the cuts down. So no vector meets more cells than it must, the result is
exact, and distances are computed in blocks inside one cell and never emitted as pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.storage import materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 2_048
MAX_CELLS = 8_192
_SAMPLE_PER_CELL = 24
# Vectors visiting one cell are spread over groups of this size.
_VISITORS = 50_000
_BLOCK = 512

_FOUND = "near_d array<double>, near_id array<long>, near_copies array<long>"


def _cut_space(sample: np.ndarray, cells: int) -> list[tuple]:
    """Nested median cuts as (dimension, threshold, left, right); a leaf is (-1, cell)."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        dim = int(np.argmax(spread))
        if wanted > 1 and spread[dim] > 0:
            threshold = float(np.median(points[:, dim]))
            left = points[:, dim] <= threshold
            if left.all():
                threshold = float(points[:, dim][points[:, dim] < threshold].max())
                left = points[:, dim] <= threshold
            nodes[at] = (dim, threshold, grow(points[left], wanted // 2), grow(points[~left], wanted - wanted // 2))
        else:
            nodes[at] = (-1, leaves)
            leaves += 1
        return at

    grow(sample, cells)
    return nodes


def _cell_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        node = nodes[at]
        if node[0] < 0:
            out[rows] = node[1]
            continue
        left = points[rows, node[0]] <= node[1]
        todo += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def _boxes_of(nodes: list[tuple], names: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounding box of every node, from those of the cells below it; an empty cell is infinitely far away."""
    lows, highs = np.full((len(nodes), low.shape[1]), np.inf), np.full((len(nodes), low.shape[1]), -np.inf)
    held = {int(cell): place for place, cell in enumerate(names)}
    for at in range(len(nodes) - 1, -1, -1):  # children come behind their parent
        node = nodes[at]
        if node[0] >= 0:
            lows[at], highs[at] = np.minimum(lows[node[2]], lows[node[3]]), np.maximum(highs[node[2]], highs[node[3]])
        elif node[1] in held:
            lows[at], highs[at] = low[held[node[1]]], high[held[node[1]]]
    return lows, highs


def _reached(nodes: list[tuple], lows: np.ndarray, highs: np.ndarray, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each cell whose box lies within a point's squared radius: from the root down, no box below one out of reach."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        part = points[rows]
        gap = np.zeros(len(rows))
        for dim in range(points.shape[1]):
            value = part[:, dim]
            gap += np.maximum(0, np.maximum(lows[at, dim] - value, value - highs[at, dim])) ** 2
        rows = rows[(gap <= radius[rows]) & (lows[at, 0] <= highs[at, 0])]
        if len(rows) == 0:
            continue
        node = nodes[at]
        if node[0] < 0:
            found.append((rows, np.full(len(rows), node[1], dtype=np.int64)))
        else:
            todo += [(node[2], rows), (node[3], rows)]
    row, cell = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, cell


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _search(query: pd.DataFrame, stored: pd.DataFrame, k: int) -> dict[str, list[np.ndarray]]:
    """The k nearest stored vectors of every query vector, itself left out."""
    points, ids, copies = _matrix(stored["x"]), stored["id"].to_numpy(), stored["copies"].to_numpy()
    wanted, own = _matrix(query["x"]), query["id"].to_numpy()
    out: dict[str, list[np.ndarray]] = {"near_d": [], "near_id": [], "near_copies": []}
    take = min(k, len(ids))
    for start in range(0, len(wanted), _BLOCK):
        block = wanted[start : start + _BLOCK]
        d = np.zeros((len(block), len(points)))
        for dim in range(points.shape[1]):
            d += (block[:, dim, None] - points[None, :, dim]) ** 2
        d[own[start : start + _BLOCK, None] == ids[None, :]] = np.inf
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        for row, found in enumerate(near):
            found = found[np.isfinite(d[row, found])]
            out["near_d"].append(d[row, found])
            out["near_id"].append(ids[found])
            out["near_copies"].append(copies[found])
    return out


def _route(nodes: list[tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=_cell_of(nodes, _matrix(batch["x"])))

    return assign


def nearest(vectors: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add `near`, the k nearest other vectors by Euclidean distance, nearest first.

    `vectors` has distinct `x` arrays, a unique `id`, and `copies`; it should be cheap to read, it is
    scanned several times. An element of `near` has near_d (squared distance), near_id and near_copies.
    """
    total = vectors.count()
    cells = max(1, min(MAX_CELLS, -(-total // cell_rows)))
    nodes: list[tuple] = [(-1, 0)]
    if cells > 1:
        # A bounded sample, MAX_CELLS * _SAMPLE_PER_CELL rows at most, only to place the cuts.
        wanted = cells * _SAMPLE_PER_CELL
        picked = vectors.select("x").sample(min(1.0, wanted / total), seed=cells)
        nodes = _cut_space(_matrix(picked.toPandas()["x"]), cells)

    basic = vectors.select("id", "x", "copies")
    placed = materialise(
        basic.mapInPandas(_route(nodes), "id long, x array<double>, copies long, cell long"), "cells"
    )

    def at_home(group: pd.DataFrame) -> pd.DataFrame:
        found = _search(group, group, k)
        radius = [d.max() if len(d) >= k else float("inf") for d in found["near_d"]]
        return group.drop(columns="copies").assign(radius=radius, **found)

    # As many partitions as cells: one cell per task, however few bytes it has.
    home = materialise(
        placed.repartition(cells, "cell")
        .groupBy("cell")
        .applyInPandas(at_home, f"id long, x array<double>, cell long, radius double, {_FOUND}"),
        "home",
    )
    near = ["near_d", "near_id", "near_copies"]
    lists = home.select("id", *near)
    if len(nodes) > 1:
        size = len(basic.first()["x"])
        boxes = (
            placed.groupBy("cell")
            .agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(size) for n, f in (("lo", F.min), ("hi", F.max))])
            .toPandas()
        )
        names = boxes["cell"].to_numpy()
        low = boxes[[f"lo{i}" for i in range(size)]].to_numpy()
        high = boxes[[f"hi{i}" for i in range(size)]].to_numpy()

        lows, highs = _boxes_of(nodes, names, low, high)

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), CELL_ROWS):
                    part = batch.iloc[start : start + CELL_ROWS]
                    row, cell = _reached(nodes, lows, highs, _matrix(part["x"]), part["radius"].to_numpy())
                    away = np.flatnonzero(part["cell"].to_numpy()[row] != cell)
                    # In parts: a vector without neighbours at home reaches every cell.
                    for first in range(0, len(away), _VISITORS):
                        some = away[first : first + _VISITORS]
                        yield part.iloc[row[some]][["id", "x"]].assign(cell=cell[some])

        visits = materialise(
            home.select("id", "x", "cell", "radius").mapInPandas(visit, "id long, x array<double>, cell long"),
            "visits",
        )
        # One row per cell, at most MAX_CELLS.
        groups = visits.groupBy("cell").agg(F.ceil(F.count("*") / _VISITORS).cast("int").alias("groups"))
        spread = F.broadcast(groups)
        guests = visits.join(spread, "cell").select("id", "x", "cell", F.pmod(F.hash("id"), "groups").alias("part"))
        parts = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")
        hosts = placed.join(spread, "cell").select("id", "x", "copies", "cell", parts)

        def away(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": guest["id"], **_search(guest, host, k)})

        seen = (
            guests.groupBy("cell", "part").cogroup(hosts.groupBy("cell", "part")).applyInPandas(away, f"id long, {_FOUND}")
        )
        lists = lists.unionByName(seen)
    ranked = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*near))))
    return vectors.join(lists.groupBy("id").agg(F.slice(ranked, 1, k).alias("near")), "id")
