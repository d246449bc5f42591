"""Numpy side of the price features: whole segments of rows as Arrow lists, all segments of a batch at once.

Values of a batch lie behind each other in one flat array, segment by segment; missing ones are NaN inside and NULL outside.
Only running sums go block by block, every other step is one operation over the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (NULL as NaN) and the segments' bounds in them."""
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float), bounds


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _known(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values)) if values.dtype.kind == "f" else pa.array(values)


def lists_of(columns: Mapping[str, np.ndarray], bounds: np.ndarray) -> pa.ListArray:
    """One list of structs for each segment."""
    rows = pa.StructArray.from_arrays([_known(v) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)


class Batch:
    """Rows of whole segments: `of` is a row's segment, `local` its number in the segment."""

    def __init__(self, closes: pa.ListArray):
        self.close, self.bounds = flat(closes)
        self.sizes = np.diff(self.bounds)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.at = np.arange(len(self.close))
        self.start = self.bounds[:-1][self.of]
        self.local = self.at - self.start

    def padded(self, before: np.ndarray | None = None) -> np.ndarray:
        """The last known close up to the row, from its segment or `before` it."""
        last = np.maximum.accumulate(np.where(np.isnan(self.close), -1, self.at)) if len(self.at) else self.at
        inside = last >= self.start
        other = np.full(len(self.at), np.nan) if before is None else before[self.of]
        return np.where(inside, self.close[np.where(inside, last, 0)], other) if len(self.at) else self.close

    def earlier(self, values: np.ndarray, behind: tuple[np.ndarray, np.ndarray], back: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The value `back` rows earlier, from the segment or the lists before it; NaN beyond the series."""
        held, bounds = behind
        at, local, of = self.at[rows], self.local[rows], self.of[rows]
        place = bounds[1:][of] + local - back
        return self._picked(values, at - back, local >= back, held, place, place >= bounds[:-1][of])

    def later(self, values: np.ndarray, ahead: tuple[np.ndarray, np.ndarray], steps: int) -> np.ndarray:
        held, bounds = ahead
        beyond = self.local + steps - self.sizes[self.of]
        place = bounds[:-1][self.of] + beyond
        return self._picked(values, self.at + steps, beyond < 0, held, place, place < bounds[1:][self.of])

    @staticmethod
    def _picked(values: np.ndarray, at: np.ndarray, inside: np.ndarray, held: np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.full(len(at), np.nan)
        out[inside] = values[at[inside]]
        outside = ~inside & there
        out[outside] = held[place[outside]]
        return out


def divided(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Quotient, missing where the denominator is zero or missing."""
    return np.divide(over, under, out=np.full(len(over), np.nan), where=~np.isnan(under) & (under != 0))


def padded_tails(closes: pa.ListArray, rows: int) -> pa.ListArray:
    """For each segment the last known closes at its last rows."""
    batch = Batch(closes)
    kept = batch.local >= batch.sizes[batch.of] - rows
    bounds = np.concatenate([[0], np.cumsum(np.minimum(batch.sizes, rows))])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _known(batch.padded()[kept]))


def volatility(batch: Batch, behind: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """Sample deviation over mean of the last rows, missing until the window is full of known closes."""
    out = np.full(len(batch.at), np.nan)
    inner, crossing = (np.flatnonzero(c) for c in (batch.local >= window - 1, batch.local < window - 1))
    # Inside a segment the moments are updated value by value, oldest first.
    total, mean, square = (np.zeros(len(inner)) for _ in range(3))
    for k in range(window):
        x = batch.close[inner - (window - 1 - k)]
        delta = x - mean
        part = delta / (k + 1.0)
        mean = mean + part
        square = square + delta * (delta - part)
        total = total + x
    out[inner] = divided(np.sqrt(square / (window - 1.0)), total / window)
    values = [batch.earlier(batch.close, behind, window - 1 - k, crossing) for k in range(window)]
    mean = sum(values, np.zeros(len(crossing))) / window
    square = sum([(x - mean) * (x - mean) for x in values], np.zeros(len(crossing)))
    out[crossing] = divided(np.sqrt(square / (window - 1)), mean)
    return out


class Average:
    """See `series._Average`; powers come as tables, so that every engine has the same ones."""

    def __init__(self, length: int, start: int, alpha: float, kept: np.ndarray, grown: np.ndarray):
        self.length, self.start, self.seed, self.alpha = length, start, start + length - 1, alpha
        self._kept, self._grown = kept, grown

    def meets(self, row: np.ndarray, first: np.ndarray) -> None:
        decays = np.maximum(row - self.seed, 0) - np.maximum(first - 1 - self.seed, 0)
        self.kept, self.growth = self._kept[decays], self._grown[decays]
        self.gain = np.where(row < self.start, 0.0, np.where(row <= self.seed, 1.0 / self.length, self.alpha))

    def grown(self, value: np.ndarray) -> np.ndarray:
        """What the row adds, weighted as of the block's start."""
        return np.nan_to_num(self.gain * value * self.growth, nan=0.0, posinf=np.inf, neginf=-np.inf)


class Blocks:
    """Rows of a batch with their block and the states that they would have if nothing lay before it."""

    def __init__(
        self, batch: Batch, padded: np.ndarray, before: np.ndarray, behind: tuple[np.ndarray, np.ndarray], block_rows: int,
        averages: Mapping[str, Average], weights: np.ndarray,
    ):
        block = batch.local // block_rows
        start = batch.start + block * block_rows
        self.row = before[batch.of] + batch.local
        self.first = before[batch.of] + block * block_rows
        self.block, self.starts = block, np.flatnonzero(batch.at == start)
        self.ends = np.append(self.starts[1:], len(batch.at)) - 1
        fast, slow, signal = (averages[c] for c in ("fast", "slow", "signal"))
        for a in (fast, slow, signal):
            a.meets(self.row, self.first)
        move = batch.close - batch.earlier(batch.close, behind, 1)
        known = ~np.isnan(move)
        moved = np.where(known, move, 0.0) * weights[self.row - self.first]
        sums = self._running([fast.grown(padded), slow.grown(padded), known.astype(float), np.maximum(moved, 0.0), np.abs(moved)])
        self.moves, self.gains, self.sizes = sums[2:]
        self.fast, self.slow = sums[0] * fast.kept, sums[1] * slow.kept
        sums = self._running([signal.grown(self.fast - self.slow), signal.grown(fast.kept), signal.grown(slow.kept)])
        self.signal, self.by_fast, self.by_slow = (s * signal.kept for s in sums)
        self.kept = {c: a.kept for c, a in averages.items()}
        last = np.maximum.accumulate(np.where(known & (move != 0), batch.at, -1)) if len(batch.at) else batch.at
        self.moved_at = np.where(last >= start, self.row[last], np.nan)

    def _running(self, values: list[np.ndarray]) -> np.ndarray:
        sums = np.stack(values)
        for a, b in zip(self.starts, self.ends + 1, strict=True):
            np.cumsum(sums[:, a:b], axis=1, out=sums[:, a:b])
        return sums
