"""Fixed-length price sequences and the classifier that reads them."""

from __future__ import annotations

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import round_half_even
from quantloom.operators import segments as seg
from quantloom.operators.order import row_positions

# Sequence length, label distance, hidden layer, tickers, held-out tail share.
LOOK_BACK, LOOK_FORWARD = 60, 20
HIDDEN_UNITS = 25
TOP_TICKERS = 50
TAIL_SHARE = 0.1


def top_by_market_cap(listing: DataFrame, last_closes: DataFrame, limit: int = TOP_TICKERS) -> DataFrame:
    """The `limit` instruments with the largest close * shares."""
    return (
        listing.join(last_closes, "ticker")
        .select("ticker", "name", (F.col("last_close") * F.col("shares")).alias("market_cap"))
        .orderBy(F.desc("market_cap"), "ticker")
        .limit(limit)
    )


def _scaled(low: Column, high: Column) -> Column:
    return F.when(low == high, 0.0).otherwise((F.col("close") - low) / (high - low))


def with_scaled_close(bars: DataFrame) -> DataFrame:
    """Add `scaled`: the close between its ticker's minimum and maximum; a constant series gives 0.

    The range of a ticker is pre-aggregated and joined, so it is that of the whole series whatever its length.
    """
    span = bars.groupBy("ticker").agg(F.min("close").alias("_min"), F.max("close").alias("_max"))
    scaled = _scaled(F.col("_min"), F.col("_max"))
    return bars.join(span, "ticker").withColumn("scaled", scaled).drop("_min", "_max")


def sequences(
    bars: DataFrame, look_back: int = LOOK_BACK, look_forward: int = LOOK_FORWARD, segment_days: int = seg.SEGMENT_DAYS
) -> DataFrame:
    """Every bar with `sequence` (its last `look_back` scaled closes, NULL before) and the `later` value, on one path.

    Inside a calendar segment by windows, across its ends by the last and first values of the segments around it.
    """
    own = seg.numbered(seg.cut(with_scaled_close(bars), segment_days))
    summary = own.groupBy(*seg.SEGMENT).agg(
        seg.last_rows(F.col("scaled"), look_back - 1).alias("_tail"), seg.first_rows(F.col("scaled"), look_forward).alias("_head")
    )
    summary = summary.select(
        *seg.SEGMENT, seg.values_before("_tail", look_back - 1).alias("_behind"), seg.values_after("_head", look_forward).alias("_ahead")
    )
    placed = seg.with_summary(own, summary)
    local = F.col("_local")
    frame = seg.in_segment().rowsBetween(-(look_back - 1), Window.currentRow)
    before = F.filter(seg.last_of(F.col("_behind"), look_back - 1 - local), lambda x: x.isNotNull())
    nothing = F.array().cast("array<double>")
    values = F.concat(F.when(local < look_back - 1, before).otherwise(nothing), F.collect_list("scaled").over(frame))
    beyond = local + look_forward - F.col("_n")
    outside = F.try_element_at(F.col("_ahead"), (F.greatest(beyond, F.lit(0)) + 1).cast("int"))
    later = F.when(beyond < 0, F.lead("scaled", look_forward).over(seg.in_segment())).otherwise(outside)
    return placed.withColumns({"_values": values, "later": later}).select(
        *bars.columns, "scaled", F.when(F.size("_values") == look_back, F.col("_values")).alias("sequence"), "later"
    )


def newest_sequences(bars: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """(ticker, sequence): the last `look_back` scaled closes of every ticker that has as many.

    Only the last rows of a ticker leave the map side, and only they are collected.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    kept = with_scaled_close(bars).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= look_back)
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("date", "scaled"))), lambda x: x["scaled"])
    found = kept.groupBy("ticker").agg(gathered.alias("sequence"), F.count("scaled").alias("_known"))
    return found.where((F.col("_known") == look_back)).select("ticker", "sequence")


def labelled(sequences: DataFrame) -> DataFrame:
    """Samples: full sequences with a known later close, 1 when that is higher than the last one."""
    complete = sequences.where(F.col("sequence").isNotNull() & F.col("later").isNotNull())
    return complete.withColumn("target", (F.col("later") > F.col("scaled")).cast("int")).drop("later")


def tail_split(samples: DataFrame, tail_share: float = TAIL_SHARE) -> DataFrame:
    """Add `position` in (ticker, date) order and `is_tail` for the last share of all samples."""
    placed = row_positions(samples, ["ticker", "date"])
    total = placed.agg(F.count("*").alias("_total"))
    first = F.floor(F.col("_total") * F.lit(1.0 - tail_share))
    return placed.crossJoin(F.broadcast(total)).withColumn("is_tail", F.col("position") > first).drop("_total")


def train_sequence_model(
    samples: DataFrame, epochs: int = 20, hidden: int = HIDDEN_UNITS, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """Feed-forward classifier on the sequences; `samples` has sequence and target."""
    data = samples.select(array_to_vector("sequence").alias("features"), F.col("target").cast("double").alias("label"))
    length = LOOK_BACK
    return MultilayerPerceptronClassifier(layers=[length, hidden, 2], maxIter=epochs, seed=seed).fit(data)


def sequence_accuracy(model: MultilayerPerceptronClassificationModel, samples: DataFrame) -> DataFrame:
    """(samples, accuracy): share of right predictions, for the held-out tail."""
    scored = model.transform(samples.withColumn("features", array_to_vector("sequence")))
    right = F.avg((F.col("prediction").cast("int") == F.col("target")).cast("double"))
    return scored.agg(F.count("*").alias("samples"), right.alias("accuracy"))


def save_sequence_model(model: MultilayerPerceptronClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_sequence_model(path: str) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(path)


def trend_scores(model: MultilayerPerceptronClassificationModel, newest: DataFrame) -> DataFrame:
    """(ticker, dl_trend_score): 100 * P(up) for the sequences of `newest_sequences`."""
    scored = model.transform(newest.withColumn("features", array_to_vector("sequence")))
    up = vector_to_array("probability")[1]
    return scored.select("ticker", round_half_even(100 * up).alias("dl_trend_score"))
