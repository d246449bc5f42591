"""Growing the trees of a forest by numpy, each tree inside one task that holds all rows as bytes.

A feature's values become the number of the cut they fall behind, so a row is one byte for each feature. Trees are grown
level by level: the rows of a tree lie sorted by node, and one count over (node, class, byte) serves all nodes of a level.
A node looks at a random part of the features, takes the split with the largest fall in Gini impurity, and ends where none
falls, where a child would have too few of the drawn rows, or at the last level. Nothing is pruned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

# The growing travels with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bins of a feature, as many as in the learning library.
BINS = 32


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value, as a byte; a value on a cut is not behind it."""
    out = np.empty(values.shape, dtype=np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, values[:, i])
    return out


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, seed: int, tree: int, depth: int, leaf_rows: int) -> dict[str, np.ndarray]:
    """One tree on rows drawn with replacement, its nodes as arrays; `bound` is the last byte that goes left (-1 in a leaf).

    `y` is 0 or 1; without a weight all rows weigh the same. `leaf_rows` counts drawn rows.
    """
    rng = np.random.default_rng([seed % (1 << 63), tree])
    times = rng.poisson(1.0, len(y))
    at = np.flatnonzero(times)
    features = x.shape[1]
    tried = math.ceil(math.sqrt(features))
    flat = np.ascontiguousarray(x).ravel()
    # Of each drawn row: where its bytes begin, its class, how often it was drawn, and what it weighs.
    first, label, drawn = at * features, y[at].astype(np.intp), times[at].astype(float)
    mass = drawn if weight is None else drawn * weight[at]
    sizes = np.array([len(at)])
    found: dict[str, list[np.ndarray]] = {name: [] for name in ("feature", "bound", "left", "right", "share", "level")}
    numbered = 1
    for level in range(depth + 1):
        nodes = len(sizes)
        owner = np.repeat(np.arange(nodes), sizes)
        down, up = np.bincount(label * nodes + owner, mass, 2 * nodes).reshape(2, nodes)
        share = np.divide(up, down + up, out=np.zeros(nodes), where=down + up > 0)
        feature, bound = np.full(nodes, -1), np.full(nodes, -1)
        count = down + up if mass is drawn else np.bincount(owner, drawn, nodes)
        worth = (down > 0) & (up > 0) & (count >= 2 * leaf_rows) & (level < depth)
        if worth.any():
            lines = _kept(np.repeat(worth, sizes), first, label, mass, drawn)
            picked = rng.random((int(worth.sum()), features)).argsort(axis=1)[:, :tried]
            feature[worth], bound[worth] = _best(flat, *lines, sizes[worth], picked, down[worth], up[worth], leaf_rows)
        inner = feature >= 0
        children = numbered + 2 * (np.cumsum(inner) - 1)
        nodes_here = (feature, bound, np.where(inner, children, -1), np.where(inner, children + 1, -1), share, np.full(nodes, level))
        for name, values in zip(found, nodes_here, strict=True):
            found[name].append(values)
        if not inner.any():
            break
        numbered += 2 * int(inner.sum())
        first, label, mass, drawn = _kept(np.repeat(inner, sizes), first, label, mass, drawn)
        sizes, feature, bound = sizes[inner], feature[inner], bound[inner]
        goes_left = flat.take(first + np.repeat(feature, sizes)) <= np.repeat(bound, sizes)
        to, lefts = _parted(goes_left, sizes)
        first, label, mass, drawn = _dealt(to, first, label, mass, drawn)
        sizes = np.column_stack([lefts, sizes - lefts]).ravel()
    return {name: np.concatenate(parts) for name, parts in found.items()}


def _best(flat, first, label, mass, drawn, sizes, picked, down, up, leaf_rows) -> tuple[np.ndarray, np.ndarray]:
    """For each node the feature and byte with the largest fall in impurity among the picked features; -1 where none falls."""
    nodes = len(sizes)
    base = label * (nodes * BINS) + np.repeat(np.arange(0, nodes * BINS, BINS), sizes)
    every = np.arange(nodes)
    total = down + up
    best = (down**2 + up**2) / total + 1e-12 * total
    feature, bound = np.full(nodes, -1), np.full(nodes, -1)
    for k in range(picked.shape[1]):
        key = flat.take(first + np.repeat(picked[:, k], sizes)) + base
        down_left, up_left = np.bincount(key, mass, 2 * nodes * BINS).reshape(2, nodes, BINS).cumsum(axis=2)
        left = down_left + up_left
        right = total[:, None] - left
        if mass is drawn:
            fits = (left >= leaf_rows) & (right >= leaf_rows)
        else:
            count = np.bincount(key, drawn, 2 * nodes * BINS).reshape(2, nodes, BINS).sum(axis=0).cumsum(axis=1)
            fits = (count >= leaf_rows) & (count[:, -1:] - count >= leaf_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (down_left**2 + up_left**2) / left + ((down[:, None] - down_left) ** 2 + (up[:, None] - up_left) ** 2) / right
        pure[~fits] = -1.0
        where = pure.argmax(axis=1)
        top = pure[every, where]
        better = top > best
        best[better], feature[better], bound[better] = top[better], picked[better, k], where[better]
    return feature, bound


def _parted(goes_left: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row when those of a node that go left come first, in their order, and how many do."""
    ends, upto = np.cumsum(sizes), np.cumsum(goes_left)
    lefts = np.diff(upto[ends - 1], prepend=0)
    behind = upto - np.repeat(upto[ends - 1] - lefts, sizes)  # those of the node that go left, up to here
    left_at = np.repeat(ends - sizes - 1, sizes) + behind
    right_at = np.arange(len(goes_left)) + np.repeat(lefts, sizes) - behind
    return np.where(goes_left, left_at, right_at), lefts


def _kept(keep: np.ndarray, first, label, mass, drawn) -> tuple[np.ndarray, ...]:
    if keep.all():
        return first, label, mass, drawn
    weight = mass[keep]
    return first[keep], label[keep], weight, weight if mass is drawn else drawn[keep]


def _dealt(to: np.ndarray, first, label, mass, drawn) -> tuple[np.ndarray, ...]:
    back = np.empty_like(to)
    back[to] = np.arange(len(to))
    weight = mass.take(back)
    return first.take(back), label.take(back), weight, weight if mass is drawn else drawn.take(back)
