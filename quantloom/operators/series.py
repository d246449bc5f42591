"""Per-instrument time-series features, on one path for series of every length.

Rows are cut into calendar segments (`segments.cut`), exchanged once by (ticker, segment) and held as one array for each
segment, so that what lies around a segment is joined to one row, not to each of its rows. Returns, volatility and the
label look at neighbouring rows: inside a segment, and across its ends by the last and first values of the segments around
it. The indicators are recursions that never forget, state = decay * state + gain * value. Each block of rows reduces
them to an affine map (what a state before the block becomes behind it), the maps are composed along the ticker by a
parallel scan, and the state that enters a block is applied to its rows in closed form. Nothing is cut off, and no weight
leaves the range of a double, for exponents count from the block's own start. The steps inside a segment are numpy in
Arrow batches (`recursions`).
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quantloom.operators import recursions as rec
from quantloom.operators import segments as seg

# The functions travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Window lengths, indicator periods, history gates and label of the features.
RETURN_PERIODS = {"ret_20": 20, "ret_60": 60}
VOLATILITY_ROWS = 20
RSI_LENGTH = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
SERVE_MIN_ROWS, TRAIN_MIN_ROWS = 61, 120
LABEL_AHEAD, LABEL_FACTOR = 20, 1.05

INDICATORS = ["rsi_14", "macd", "macd_hist", "macd_signal"]
PRICE_FEATURES = ["ret_20", "ret_60", "vol_20", *INDICATORS]

# Rows of a block: the weights of the fastest average stay within 1.25**1024 (1e99), far inside the range of a double.
BLOCK_ROWS = 1_024
BACK = max(*RETURN_PERIODS.values(), VOLATILITY_ROWS)


def longest_series(bars: DataFrame) -> int:
    """Rows of the longest series (0 without bars): one pre-aggregated count."""
    row = bars.groupBy("ticker").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    return row["n"] or 0


def most_blocks(bars: DataFrame, segment_days: int, block_rows: int) -> int:
    """Blocks of the longest series: one pre-aggregated count."""
    sizes = seg.cut(bars.select("ticker", "date"), segment_days).groupBy(*seg.SEGMENT).agg(F.ceil(F.count("*") / block_rows).alias("n"))
    return sizes.groupBy("ticker").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def history_gate(bars: DataFrame, min_rows: int) -> DataFrame:
    """Keep series with at least `min_rows` rows; counts are combined before the shuffle."""
    enough = bars.groupBy("ticker").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_rows).select("ticker")
    return bars.join(enough, "ticker", "left_semi")


# --- neighbours across the ends of a segment ----------------------------------------------------


def _held(bars: DataFrame, segment_days: int) -> DataFrame:
    """(ticker, _segment, _rows): the rows of each segment as an array, in the order of their dates.

    Bars that have a segment come partitioned by it; others are exchanged before they are collected.
    """
    rows = bars if "_segment" in bars.columns else seg.cut(bars, segment_days).repartition(*seg.SEGMENT)
    others = [c for c in bars.columns if c not in (*seg.SEGMENT, "date")]
    return rows.groupBy(*seg.SEGMENT).agg(F.sort_array(F.collect_list(F.struct("date", *others))).alias("_rows"))


def _closes() -> Column:
    return F.col("_rows.close").cast("array<double>")


@F.arrow_udf(ArrayType(DoubleType()))
def _padded_tails(closes: pa.Array) -> pa.Array:
    return rec.padded_tails(closes, BACK)


def _surroundings(held: DataFrame) -> DataFrame:
    """One row per segment: rows before it and of the whole series, last known close, closes around it."""
    rows = F.size("_rows").cast("long")
    tail = F.slice(_closes(), F.greatest(F.size("_rows") - (BACK - 1), F.lit(1)), BACK)
    summary = held.select(
        *seg.SEGMENT,
        rows.alias("_n"),
        tail.alias("close"),
        _padded_tails(_closes()).alias("padded"),
        F.transform(F.slice("_rows", 1, LABEL_AHEAD), lambda x: F.struct(x["close"].cast("double").alias("close"), x["date"].alias("date"))).alias("_head"),
        F.element_at("_rows", -1)["date"].alias("_last_date"),
    ).withColumns({"_known_last": F.element_at("padded", -1), "_tail": F.arrays_zip("close", "padded")})
    ticker = Window.partitionBy("ticker")
    summary = summary.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(seg.earlier()), F.lit(0)),
            "_known": F.last("_known_last", ignorenulls=True).over(seg.earlier()),
            "_series": F.sum("_n").over(ticker),
            "_end": F.max("_last_date").over(ticker),
        }
    )
    known = lambda x: F.struct(x["close"].alias("close"), F.coalesce(x["padded"], F.col("_known")).alias("padded"))
    return (
        summary.withColumn("_tail", F.transform("_tail", known))
        .withColumns({"_behind": seg.values_before("_tail", BACK), "_ahead": seg.values_after("_head", LABEL_AHEAD)})
        .select(*seg.SEGMENT, "_before", "_known", "_series", "_end", "_behind", "_ahead")
    )


def _placed(bars: DataFrame, segment_days: int) -> DataFrame:
    """Segments with their rows and what lies around them."""
    held = _held(bars, segment_days)
    return seg.with_summary(held, _surroundings(held))


def _label_ends() -> Column:
    """For each row of a segment the date that its label looks at: the series' last one where there is no later row."""
    dates = F.concat(F.col("_rows.date"), F.col("_ahead.date"))
    later = F.slice(dates, LABEL_AHEAD + 1, F.size("_rows"))
    return F.slice(F.concat(later, F.array_repeat("_end", LABEL_AHEAD)), 1, F.size("_rows"))


# --- indicators as affine maps ------------------------------------------------------------------


class _Average:
    """An exponential average whose first value, at row start + length - 1, is the mean of the first `length` values.

    Up to that row the state adds value / length and doesn't decay; from then on it is decay * state + alpha * value.
    """

    def __init__(self, length: int, start: int):
        self.length, self.seed = length, start + length - 1
        self.start, self.alpha = start, 2.0 / (length + 1)
        self.decay = 1.0 - self.alpha


_FAST, _SLOW = _Average(MACD_FAST, 0), _Average(MACD_SLOW, 0)
_SIGNAL = _Average(MACD_SIGNAL, MACD_SLOW - 1)
_AVERAGES = {"fast": _FAST, "slow": _SLOW, "signal": _SIGNAL}
_RSI_DECAY = (RSI_LENGTH - 1) / RSI_LENGTH

#: Map of a block. Averages: kept_* and *_in behind a state of zero; the signal also takes fast and slow times by_*.
#: Moves: their number, and gains and sizes weighted as of the last row that moved (`moved_at`).
_MAP = [
    "kept_fast", "kept_slow", "kept_signal", "fast", "slow", "signal", "by_fast", "by_slow", "moves", "gains", "sizes", "moved_at",
]


def _composed(x: Mapping[str, Column], y: Mapping[str, Column]) -> Mapping[str, Column]:
    """The map of two blocks in a row, x before y."""
    faded = F.pow(F.lit(_RSI_DECAY), y["moved_at"] - x["moved_at"])
    joined = lambda c: F.when(x["moved_at"].isNull(), y[c]).when(y["moved_at"].isNull(), x[c]).otherwise(y[c] + x[c] * faded)
    return {
        "kept_fast": x["kept_fast"] * y["kept_fast"],
        "kept_slow": x["kept_slow"] * y["kept_slow"],
        "kept_signal": x["kept_signal"] * y["kept_signal"],
        "fast": x["fast"] * y["kept_fast"] + y["fast"],
        "slow": x["slow"] * y["kept_slow"] + y["slow"],
        "signal": x["signal"] * y["kept_signal"] + y["by_fast"] * x["fast"] - y["by_slow"] * x["slow"] + y["signal"],
        "by_fast": x["by_fast"] * y["kept_signal"] + y["by_fast"] * x["kept_fast"],
        "by_slow": x["by_slow"] * y["kept_signal"] + y["by_slow"] * x["kept_slow"],
        "moves": x["moves"] + y["moves"],
        "gains": joined("gains"),
        "sizes": joined("sizes"),
        "moved_at": F.coalesce(y["moved_at"], x["moved_at"]),
    }


@cache
def _powers(block_rows: int) -> dict[str, np.ndarray]:
    """Powers that a block may need, by the engine's own function: of each decay, of its inverse, and the weights of moves."""
    bases = {"weights": 1 / _RSI_DECAY}
    for name, average in _AVERAGES.items():
        bases |= {name: average.decay, f"1/{name}": 1 / average.decay}
    spark = SparkSession.getActiveSession()
    table = spark.range(0, block_rows + 1, 1, 1).select("id", *[F.pow(F.lit(base), F.col("id")).alias(name) for name, base in bases.items()])
    rows = sorted(table.collect())  # one row for each row of a block
    return {name: np.array([r[name] for r in rows]) for name in bases}


def _blocks(powers: dict[str, np.ndarray], block_rows: int, closes: pa.Array, before: pa.Array, known: pa.Array, behind: pa.Array) -> tuple[rec.Batch, np.ndarray, rec.Blocks]:
    batch = rec.Batch(closes)
    padded = batch.padded(rec.numbers(known))
    averages = {n: rec.Average(a.length, a.start, a.alpha, powers[n], powers[f"1/{n}"]) for n, a in _AVERAGES.items()}
    start = rec.numbers(before).astype(np.int64)
    return batch, padded, rec.Blocks(batch, padded, start, rec.flat(behind), block_rows, averages, powers["weights"])


def _entering(placed: DataFrame, block_rows: int, rounds: int) -> DataFrame:
    """(ticker, _segment, _entering): for each block of the segment, in order, the states before it."""
    powers = _powers(block_rows)

    @F.arrow_udf("array<struct<" + ",".join(f"{c}:double" for c in [*_MAP, "_first"]) + ">>")
    def maps(closes: pa.Array, before: pa.Array, known: pa.Array, behind: pa.Array) -> pa.Array:
        batch, _, b = _blocks(powers, block_rows, closes, before, known, behind)
        found = {f"kept_{n}": kept for n, kept in b.kept.items()}
        found |= {c: getattr(b, c) for c in _MAP if c not in found}
        found["_first"] = b.first.astype(float)
        blocks = np.bincount(batch.of[b.ends], minlength=len(batch.sizes)) if len(batch.at) else batch.sizes
        return rec.lists_of({c: v[b.ends] for c, v in found.items()}, np.concatenate([[0], np.cumsum(blocks)]))

    ends = placed.select(*seg.SEGMENT, F.posexplode(maps(_closes(), "_before", "_known", "_behind.close")).alias("_block", "map"))
    as_moved = F.pow(F.lit(_RSI_DECAY), F.col("map.moved_at") - F.col("map._first"))
    weighted = {"gains": F.col("map.gains") * as_moved, "sizes": F.col("map.sizes") * as_moved}
    blocks = ends.select(*seg.SEGMENT, "_block", *[weighted.get(c, F.col(f"map.{c}")).alias(c) for c in _MAP])
    states = seg.composed(blocks, _composed, _MAP, rounds)
    entry = F.struct("_block", *[F.col(f"_back.{c}").alias(c) for c in (*_STATES, "moved_at")])
    return states.groupBy(*seg.SEGMENT).agg(F.sort_array(F.collect_list(entry)).alias("_entering"))


_STATES = ("fast", "slow", "signal", "moves", "gains", "sizes")


def _with_entering(placed: DataFrame, block_rows: int, rounds: int) -> DataFrame:
    """Add `_entering` with `faded`, what a block's start has left of the moves before it."""

    def of(e: Column, block: Column) -> Column:
        # Without a move in the block the ratio is that of the last move, however long ago it was.
        faded = F.pow(F.lit(_RSI_DECAY), F.col("_before") + block * block_rows - e["moved_at"])
        return F.struct(*[F.coalesce(e[c], F.lit(0.0)).alias(c) for c in _STATES], F.coalesce(faded, F.lit(0.0)).alias("faded"))

    met = seg.with_summary(placed, _entering(placed, block_rows, rounds))
    return met.withColumn("_entering", F.transform("_entering", of))


def _indicators(batch: rec.Batch, padded: np.ndarray, b: rec.Blocks, entering: pa.Array) -> dict[str, np.ndarray]:
    """RSI: share of exponentially weighted gains in all moves, times 100; both averages are normalised alike, so weighted
    sums are enough. Missing until 14 moves are known, and while nothing has moved. MACD: difference of two averages (from
    row 25), its own average (from row 33) and their difference; missing while no close is known.
    """
    firsts = np.concatenate([[0], np.cumsum(entering.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    entry, states = firsts[:-1][batch.of] + b.block, entering.flatten()
    of = {c: rec.numbers(states.field(c))[entry] for c in (*_STATES, "faded")}
    line = b.fast - b.slow + b.kept["fast"] * of["fast"] - b.kept["slow"] * of["slow"]
    signal = b.signal + b.kept["signal"] * of["signal"] + b.by_fast * of["fast"] - b.by_slow * of["slow"]
    total = {c: np.where(np.isnan(b.moved_at), of[c], getattr(b, c) + of[c] * of["faded"]) for c in ("gains", "sizes")}
    known = ~np.isnan(padded)
    macd = np.where((b.row >= MACD_SLOW - 1) & known, line, np.nan)
    macd_signal = np.where((b.row >= MACD_SLOW + MACD_SIGNAL - 2) & known, signal, np.nan)
    rsi = np.where(b.moves + of["moves"] >= RSI_LENGTH, 100 * rec.divided(total["gains"], total["sizes"]), np.nan)
    return {"rsi_14": rsi, "macd": macd, "macd_signal": macd_signal, "macd_hist": macd - macd_signal}


# --- all together -------------------------------------------------------------------------------


def featured(
    bars: DataFrame,
    columns: Sequence[str] = PRICE_FEATURES,
    longest: int | None = None,
    min_rows: int = 0,
    segment_days: int = seg.SEGMENT_DAYS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the named features (of PRICE_FEATURES, `target`, and `target_end`, the date that the label looks at) to the series with at least `min_rows` rows.

    `longest` is a known bound on the rows of a series with one row a day (for example the days of a date range); without
    it the number of blocks is counted. It only sets the rounds of the scan; a wrong bound is an error, never a wrong value.
    """
    placed = _placed(bars, segment_days)
    if min_rows:
        placed = placed.where(F.col("_series") >= min_rows)
    recursive = bool(set(INDICATORS) & set(columns))
    if recursive:
        blocks = most_blocks(bars, segment_days, block_rows) if longest is None else longest // block_rows + longest // segment_days + 2
        placed = _with_entering(placed, block_rows, seg.rounds_for(blocks))
    powers = _powers(block_rows) if recursive else {}
    found = [c for c in columns if c != "target_end"]
    rows = ["_rows"]

    @F.arrow_udf("array<struct<" + ",".join(f"{c}:{'int' if c == 'target' else 'double'}" for c in found or ["none"]) + ">>")
    def features(closes: pa.Array, before: pa.Array, known: pa.Array, behind: pa.Array, padded_behind: pa.Array, ahead: pa.Array, entering: pa.Array) -> pa.Array:
        batch = rec.Batch(closes)
        padded = batch.padded(rec.numbers(known))
        around = rec.flat(behind)
        out: dict[str, np.ndarray] = {}
        for c, periods in RETURN_PERIODS.items():
            if c in found:
                out[c] = rec.divided(padded, batch.earlier(padded, rec.flat(padded_behind), periods)) - 1
        if "vol_20" in found:
            out["vol_20"] = rec.volatility(batch, around, VOLATILITY_ROWS)
        if "target" in found:
            change = rec.divided(batch.later(batch.close, rec.flat(ahead), LABEL_AHEAD), batch.close)
            out["target"] = (change > LABEL_FACTOR).astype(np.int32)
        if recursive:
            _, _, states = _blocks(powers, block_rows, closes, before, known, behind)
            out |= _indicators(batch, padded, states, entering)
        return rec.lists_of({c: out[c] for c in found}, batch.bounds)

    if found:
        entering = F.col("_entering") if recursive else F.lit(None).cast("array<struct<none:double>>")
        around = [F.col("_behind.close"), F.col("_behind.padded"), F.col("_ahead.close")]
        placed = placed.withColumn("_found", features(_closes(), "_before", "_known", *around, entering))
        rows.append("_found")
    if "target_end" in columns:
        placed = placed.withColumn("_ends", _label_ends())
        rows.append("_ends")
    each = placed.select(*seg.SEGMENT, F.explode(F.arrays_zip(*rows)).alias("_row"))
    own = {c: F.col(c) if c in seg.SEGMENT else F.col(f"_row._rows.{c}") for c in bars.columns}
    added = {c: F.col("_row._ends") if c == "target_end" else F.col(f"_row._found.{c}") for c in columns}
    return each.select(*[column.alias(c) for c, column in (own | added).items()])


def latest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row of the last date per ticker: a pre-aggregating maximum, no second sort."""
    picked = F.max_by(F.struct("date", *columns), F.col("date"))
    return df.groupBy("ticker").agg(picked.alias("_last")).select("ticker", "_last.*")
