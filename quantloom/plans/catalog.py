"""Named queries over the test tables, one per operator. Each reads its whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import numeric as num
from quantloom.operators import blend as bl
from quantloom.operators import forest, metrics, sampling, scores, sentiment, series
from quantloom.operators import fundamentals as fund
from quantloom.operators import sequences as seq
from quantloom.operators.impute import medians
from quantloom.operators.order import counts_of, min_ranks, pct_rank, rank_nulls_last
from quantloom.plans import serving, training
from quantloom.sources import derived, readers
from quantloom.storage import materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]

# Median number of bars in the serving window: splits the instruments into kept and dropped ones.
SPLITTING_GATE = 85
QUERIES: dict[str, Query] = {}


class Inputs:
    """The derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def as_of(self) -> dt.date:
        return derived.last_day(self.spark, self.sf_dir)

    @cached_property
    def listing(self) -> DataFrame:
        return derived.listing(self.spark, self.sf_dir)

    @cached_property
    def tradable(self) -> DataFrame:
        return readers.tradable(self.listing, derived.EXCLUDED_NAMES)

    @cached_property
    def code_map(self) -> DataFrame:
        return derived.code_map(self.spark, self.sf_dir)

    @cached_property
    def statements(self) -> DataFrame:
        return derived.statements(self.spark, self.sf_dir)

    @cached_property
    def bars(self) -> DataFrame:
        return derived.bars(self.spark, self.sf_dir)

    @cached_property
    def span(self) -> int:
        """Days between the first and the last bar: with one bar a day, the longest possible series."""
        return derived.span_days(self.spark, self.sf_dir)

    def statements_of(self, first: int, last: int) -> DataFrame:
        """Statements of these years; the years reach the scan as a date range."""
        return derived.statements(self.spark, self.sf_dir, (first, last))

    def bars_since(self, days: int) -> DataFrame:
        return derived.bars(self.spark, self.sf_dir, readers.days_before(self.as_of, days), self.as_of)

    @cached_property
    def headlines(self) -> DataFrame:
        found = derived.headlines(self.spark, self.sf_dir)
        return found.withColumn("date", F.date_sub(F.lit(self.as_of), F.col("age_days").cast("int"))).drop("age_days")

    @cached_property
    def valued(self) -> DataFrame:
        return serving.valued_universe(
            self.listing,
            self.code_map,
            self.bars_since(readers.SERVE_DAYS),
            self.statements,
            self.as_of,
            derived.EXCLUDED_NAMES,
            one_bar_a_day=True,
        )

    @cached_property
    def universe(self) -> tuple[DataFrame, int]:
        return serving.imputed_universe(self.valued)

    @cached_property
    def scored(self) -> DataFrame:
        universe, rows = self.universe
        return scores.factor_scores(universe, rows)

    @cached_property
    def history(self) -> DataFrame:
        return training.feature_history(
            self.listing,
            self.code_map,
            self.bars_since(readers.TRAIN_DAYS),
            self.statements,
            self.as_of,
            derived.EXCLUDED_NAMES,
            one_bar_a_day=True,
        )

    @cached_property
    def training_rows(self) -> DataFrame:
        return training.training_rows(self.history)

    def every_series(self, *columns: str) -> DataFrame:
        """These features over the whole history of every instrument."""
        return series.featured(self.bars, columns, self.span).select("ticker", "date", *columns)


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for a comparison between engines; adding zero removes the sign of a negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# --- scans and filters -------------------------------------------------------------------------


@query
def listing_scan(i: Inputs) -> DataFrame:
    return i.listing


@query
def listing_filter(i: Inputs) -> DataFrame:
    return i.tradable


@query
def bars_range(i: Inputs) -> DataFrame:
    return i.bars_since(readers.SERVE_DAYS)


@query
def as_of_date(i: Inputs) -> DataFrame:
    return readers.as_of_frame(i.bars)


@query
def statements_scan(i: Inputs) -> DataFrame:
    return i.statements_of(i.as_of.year - 1, i.as_of.year - 1)


@query
def statements_by_year(i: Inputs) -> DataFrame:
    years = training.statement_years(i.as_of)
    return i.statements_of(years[0], years[-1])


@query
def statement_documents(i: Inputs) -> DataFrame:
    """Statements landed as JSON documents with a status, parsed back: those without the data status hold nothing."""
    return readers.documents_to_rows(readers.parse_documents(derived.documents(i.spark, i.sf_dir)), {})


@query
def code_map_scan(i: Inputs) -> DataFrame:
    """Code map lines parsed as CSV; both columns keep their leading zeros."""
    return readers.parse_code_map(derived.code_map_lines(i.spark, i.sf_dir))


@query
def code_map_build(i: Inputs) -> DataFrame:
    return readers.build_code_map(derived.companies(i.spark, i.sf_dir))


@query
def landed_statements(i: Inputs) -> DataFrame:
    """Documents landed as files in year folders and read back: rows of two years, and what was put aside."""
    path = new_path(i.spark, "landed")
    readers.land_documents(derived.broken_documents(i.spark, i.sf_dir), path)
    years = [i.as_of.year - 2, i.as_of.year - 1]
    good = readers.read_statements(i.spark, path, years, {})
    aside = readers.quarantined(readers.read_landed(i.spark, path, years)).groupBy("year", "reason").agg(F.count("*").alias("documents"))
    nothing = F.lit(None).cast("string")
    return good.withColumns({"reason": nothing, "documents": F.lit(None).cast("long")}).unionByName(
        aside.withColumns({c: nothing for c in ("ticker", "account", "amount_raw")})
    )


@query
def code_map_round_trip(i: Inputs) -> DataFrame:
    """A code map with commas and quotes in its codes, written as several CSV files and one with a byte-order mark, and read back."""
    path = new_path(i.spark, "code-map")
    codes = derived.quoted_code_map(i.spark, i.sf_dir)
    odd = F.col("ticker").cast("long") % 2 == 1
    readers.write_code_map(codes.where(odd).repartition(3, "ticker"), f"{path}/plain")
    readers.write_code_map(codes.where(~odd), f"{path}/marked", byte_order_mark=True)
    return readers.union_sources(readers.read_code_map(i.spark, f"{path}/plain"), readers.read_code_map(i.spark, f"{path}/marked"))


@query
def merged_providers(i: Inputs) -> DataFrame:
    """Bars of shipped items before those of all items: precedence, gaps and conflicts of two providers."""
    first, second = (derived.bars(i.spark, i.sf_dir, line=line) for line in ("F", None))
    return readers.merged_providers([first, second], ["shipped", "all"], tolerance=0.01)


@query
def union_sources(i: Inputs) -> DataFrame:
    open_items, closed_items = (derived.bars(i.spark, i.sf_dir, line=s) for s in ("O", "F"))
    return readers.union_sources(open_items, closed_items.select("volume", "close", "date", "ticker"))


@query
def history_gate(i: Inputs) -> DataFrame:
    kept = series.history_gate(i.bars_since(readers.SERVE_DAYS), SPLITTING_GATE)
    return kept.select("ticker", "date", "volume")


@query
def parse_amount(i: Inputs) -> DataFrame:
    return i.statements.withColumn("amount", num.parse_amount(F.col("amount_raw")))


@query
def inf_to_null(i: Inputs) -> DataFrame:
    inverse = num.inverse_or_floor(num.parse_amount(F.col("amount_raw")))
    found = i.statements.select("ticker", "year", "account", num.finite(inverse * 1e6).alias("inverse"))
    return rounded(found, 9, "inverse")


@query
def market_cap(i: Inputs) -> DataFrame:
    value = num.market_cap(F.col("close"), F.col("shares"))
    return i.bars.join(i.tradable, "ticker").select("ticker", "date", (value / num.WON_PER_EOK).alias("market_cap_eok"))


# --- joins and fundamentals --------------------------------------------------------------------


@query
def listing_code_join(i: Inputs) -> DataFrame:
    return fund.mapped_universe(i.tradable, i.code_map)


@query
def distinct_codes(i: Inputs) -> DataFrame:
    return fund.distinct_codes(fund.mapped_universe(i.tradable, i.code_map))


@query
def statements_pivot(i: Inputs) -> DataFrame:
    return rounded(fund.pivot_statements(i.statements, ["ticker", "year"]), 3, *fund.ACCOUNTS)


@query
def fundamentals_complete(i: Inputs) -> DataFrame:
    """Instruments that keep both accounts after filling."""
    window = i.bars_since(readers.TRAIN_DAYS)
    filled = fund.filled_amounts(window, i.statements, training.statement_years(i.as_of))
    return filled.groupBy("ticker").agg(F.count("*").alias("years"))


@query
def ffill_bfill(i: Inputs) -> DataFrame:
    window = i.bars_since(readers.TRAIN_DAYS)
    filled = fund.filled_amounts(window, i.statements, training.statement_years(i.as_of))
    return rounded(filled, 3, *fund.ACCOUNTS)


@query
def bars_fundamentals(i: Inputs) -> DataFrame:
    window = i.bars_since(readers.TRAIN_DAYS)
    filled = fund.filled_amounts(window, i.statements, training.statement_years(i.as_of))
    joined = fund.with_fundamentals(window, filled)
    return rounded(joined.select("ticker", "date", *fund.ACCOUNTS), 3, *fund.ACCOUNTS)


@query
def point_in_time(i: Inputs) -> DataFrame:
    """Every bar with the last statement published by its date."""
    yearly = fund.pivot_statements(i.statements, ["ticker", "year"])
    published = yearly.join(derived.publications(i.spark, i.sf_dir), ["ticker", "year"]).drop("year")
    found = fund.with_published(i.bars.select("ticker", "date"), published)
    return rounded(found, 3, *fund.ACCOUNTS)


@query
def valuation_history(i: Inputs) -> DataFrame:
    return i.history.select("ticker", "date", "market_cap", *fund.RATIOS)


@query
def valuation_latest(i: Inputs) -> DataFrame:
    return i.valued.select("ticker", "name", "date", "last_close", "market_cap_eok", *fund.RATIOS)


# --- time series -------------------------------------------------------------------------------


@query
def ret_20(i: Inputs) -> DataFrame:
    return rounded(i.every_series("ret_20"), 6, "ret_20")


@query
def ret_60(i: Inputs) -> DataFrame:
    return rounded(i.every_series("ret_60"), 6, "ret_60")


@query
def vol_20(i: Inputs) -> DataFrame:
    return rounded(i.every_series("vol_20"), 6, "vol_20")


@query
def rsi_14(i: Inputs) -> DataFrame:
    return rounded(i.every_series("rsi_14"), 6, "rsi_14")


@query
def macd(i: Inputs) -> DataFrame:
    columns = ["macd", "macd_signal", "macd_hist"]
    return rounded(i.every_series(*columns), 3, *columns)


@query
def label_up5(i: Inputs) -> DataFrame:
    return i.every_series("target")


@query
def latest_bar(i: Inputs) -> DataFrame:
    return series.latest(i.bars, ["close", "volume"])


# Days of a segment of trades: a task's windows should hold its segments in memory.
TICK_SEGMENT_DAYS = 32


@query
def tick_features(i: Inputs) -> DataFrame:
    """All price features of series of many thousand trades, one for each region."""
    columns = [*series.PRICE_FEATURES, "target"]
    ticks = materialise(derived.ticks(i.spark, i.sf_dir), "ticks")
    found = series.featured(ticks, columns, segment_days=TICK_SEGMENT_DAYS)
    moment = F.unix_micros("date").alias("moment")
    averages = ["macd", "macd_hist", "macd_signal"]
    shares = [c for c in series.PRICE_FEATURES if c not in averages]
    return rounded(rounded(found.select("ticker", moment, *columns), 4, *shares), 3, *averages)


# --- ranks, scores and blend -------------------------------------------------------------------


@query
def pct_min_rank(i: Inputs) -> DataFrame:
    """Every bar's volume among all bars."""
    bars = materialise(i.bars.select("ticker", "date", "volume"), "volumes")
    ranked = min_ranks(bars, ["ticker", "date"], ["volume"])
    return ranked.select("ticker", "date", F.col("volume_rank").alias("min_rank"), pct_rank("volume").alias("pct"))


@query
def pct_min_rank_nulls_last(i: Inputs) -> DataFrame:
    """Every bar's 20-bar return among all bars; the first bars of a series have none and rank last."""
    bars = materialise(i.every_series("ret_20"), "returns")
    bars = rounded(bars, 9, "ret_20")
    counts = counts_of(bars, ["ret_20"])
    last = rank_nulls_last("ret_20")
    return min_ranks(bars, ["ticker", "date"], ["ret_20"], counts).select(
        "ticker", "date", last.alias("min_rank"), (last / F.lit(float(counts["*"]))).alias("pct")
    )


def _plain_scores(i: Inputs, *columns: str) -> DataFrame:
    """Scores of the universe without imputation: loss-makers and missing measures stay visible."""
    universe = materialise(i.valued, "valued")
    return rounded(scores.raw_factor_scores(universe, universe.count()).select("ticker", *columns), 6, *columns)


@query
def value_score(i: Inputs) -> DataFrame:
    return _plain_scores(i, "value_score")


@query
def quality_score(i: Inputs) -> DataFrame:
    return _plain_scores(i, "quality_score")


@query
def momentum_score(i: Inputs) -> DataFrame:
    return _plain_scores(i, "momentum_score")


@query
def volatility_score(i: Inputs) -> DataFrame:
    return _plain_scores(i, "volatility_score")


@query
def feature_medians(i: Inputs) -> DataFrame:
    """Median of each measure over the whole training history."""
    history = materialise(i.history.select(*training.FEATURES), "history")
    middle = medians(history, training.FEATURES)
    return rounded(i.spark.createDataFrame(list(middle.items()), "measure string, median double"), 4, "median")


@query
def impute_median(i: Inputs) -> DataFrame:
    universe, _ = i.universe
    columns = ["ret_20", "ret_60", "vol_20", *fund.RATIOS]
    return rounded(universe.select("ticker", *columns), 6, *columns)


@query
def factor_scores(i: Inputs) -> DataFrame:
    return i.scored


@query
def score_pred_left_join(i: Inputs) -> DataFrame:
    """Scores with a rule-based prediction that half of the instruments lack."""
    universe, _ = i.universe
    known = universe.where(F.col("ret_20") > 0).select("ticker", F.lit(1.0).alias("ml_pred_proba"))
    return bl.join_predictions(i.scored.select("ticker", "name", "value_score"), known)


@query
def blend_raw(i: Inputs) -> DataFrame:
    return i.scored.select("ticker", F.round(bl.blend(i.scored), 6).alias("blend"))


@query
def minmax_scale(i: Inputs) -> DataFrame:
    blended = i.scored.select("ticker", bl.blend(i.scored).alias("blend"))
    return rounded(bl.min_max(blended, "blend", "scaled").select("ticker", "scaled"), 6, "scaled")


@query
def final_rank(i: Inputs) -> DataFrame:
    """Every bar's unique position by volume; ties by ticker and date."""
    bars = i.bars.select(F.concat_ws("@", "ticker", F.col("date").cast("string")).alias("bar"), "volume")
    return bl.final_rank(bars, "volume", "bar")


@query
def final_ranking(i: Inputs) -> DataFrame:
    return bl.final_ranking(i.scored)


@query
def display_projection(i: Inputs) -> DataFrame:
    """The result table of the final ranking with a rule-based probability."""
    universe, _ = i.universe
    rule = universe.select("ticker", F.when(F.col("ret_20") > 0, 0.75).otherwise(0.25).alias("ml_pred_proba"))
    return bl.display(bl.final_ranking(bl.join_predictions(i.scored, rule)))


# --- training and evaluation -------------------------------------------------------------------


@query
def training_rows(i: Inputs) -> DataFrame:
    return rounded(i.training_rows, 4, *training.FEATURES)


@query
def class_shares(i: Inputs) -> DataFrame:
    return rounded(metrics.class_shares(i.training_rows), 9, "share")


@query
def stratified_split_sizes(i: Inputs) -> DataFrame:
    # Stored, for a range partitioning reads its rows twice: once to find the bounds.
    rows = materialise(i.training_rows.select("ticker", "date", "target"), "rows")
    parts = sampling.stratified_split(rows, ["ticker", "date"])
    return parts.groupBy("target", "is_test").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"))


# Days behind a held-out period that no training row may begin in.
EMBARGO_DAYS = 10


@query
def purged_folds(i: Inputs) -> DataFrame:
    """Rows that each of three stretches of time holds out, trains on, and purges because labels overlap."""
    bars = series.featured(i.bars_since(readers.TRAIN_DAYS), ["target_end"], readers.TRAIN_DAYS + 1)
    rows = materialise(sampling.time_folds(bars.select("ticker", "date", "target_end"), forest.FOLDS), "time-folds")
    parts = sampling.purged_folds(rows, ["ticker", "date"], embargo_days=EMBARGO_DAYS)
    return parts.groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def _ruled(i: Inputs) -> DataFrame:
    """Label against a momentum rule: prediction = positive 20-bar return, score = that return."""
    score = F.round("ret_20", 6)
    return i.training_rows.select("target", (score > 0).cast("int").alias("prediction"), score.alias("score"))


@query
def classification_report(i: Inputs) -> DataFrame:
    return rounded(metrics.classification_report(_ruled(i)), 6, "precision", "recall", "f1")


@query
def roc_auc(i: Inputs) -> DataFrame:
    return rounded(metrics.roc_auc(materialise(_ruled(i), "ruled")), 6, "auc")


@query
def smote_balance(i: Inputs) -> DataFrame:
    stored = materialise(i.training_rows, "rows")
    out = sampling.smote(stored, training.FEATURES, ["ticker", "date"])
    return out.groupBy("target", "synthetic").agg(F.count("*").alias("rows"))


_searched: dict[tuple[str, str], tuple[forest.Trained, str]] = {}


def searched(i: Inputs) -> tuple[forest.Trained, str]:
    """The search over the whole space, fitted on all training rows, and where its model is stored: done once for a session and folder."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _searched:
        stored = materialise(i.training_rows, "rows")
        trained = forest.train_forest(stored, training.FEATURES, parallelism=8)
        path = new_path(i.spark, "model")
        forest.save_model(trained.model, path)
        _searched[key] = trained, path
    return _searched[key]


@query
def forest_search(i: Inputs) -> DataFrame:
    """Area of each draw in each fold, over the whole search space with over-sampling."""
    trained, _ = searched(i)
    draws = [(k, d["numTrees"], d["maxDepth"], d["minInstancesPerNode"]) for k, d in enumerate(forest.draw_params())]
    params = i.spark.createDataFrame(draws, "draw int, trees int, max_depth int, leaf_rows int")
    return trained.areas.join(F.broadcast(params), "draw")


@query
def forest_holdout(i: Inputs) -> DataFrame:
    """Report of the searched model on the held-out rows, with its area there."""
    trained, _ = searched(i)
    return trained.report.crossJoin(F.broadcast(trained.auc.select("auc")))


@query
def ml_score(i: Inputs) -> DataFrame:
    """Every instrument's probability from the stored searched model."""
    universe, _ = i.universe
    return forest.score_instruments(forest.load_model(searched(i)[1]), universe)


@query
def ml_ranking(i: Inputs) -> DataFrame:
    """The final ranking with the searched model's probability in the blend."""
    universe, _ = i.universe
    scored = bl.join_predictions(i.scored, forest.score_instruments(forest.load_model(searched(i)[1]), universe))
    return bl.final_ranking(scored)


# --- sequences ---------------------------------------------------------------------------------


@query
def top_market_cap(i: Inputs) -> DataFrame:
    closes = series.latest(i.bars, ["close"]).withColumnRenamed("close", "last_close")
    return seq.top_by_market_cap(i.tradable, closes)


@query
def minmax_by_ticker(i: Inputs) -> DataFrame:
    return rounded(seq.with_scaled_close(i.bars).select("ticker", "date", "scaled"), 6, "scaled")


def _samples(i: Inputs) -> DataFrame:
    return seq.labelled(seq.sequences(i.bars))


@query
def sequences_60(i: Inputs) -> DataFrame:
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    found = _samples(i).select(
        "ticker",
        "date",
        F.size("sequence").alias("length"),
        F.get("sequence", F.lit(0)).alias("first_value"),
        F.get("sequence", F.lit(seq.LOOK_BACK - 1)).alias("last_value"),
        total.alias("total"),
    )
    return rounded(found, 6, "first_value", "last_value", "total")


@query
def sequence_label(i: Inputs) -> DataFrame:
    return _samples(i).select("ticker", "date", "target")


@query
def tail_split(i: Inputs) -> DataFrame:
    return seq.tail_split(_samples(i).select("ticker", "date", "target")).select(
        "ticker", "date", "position", "is_tail"
    )


def trend_model(i: Inputs) -> tuple[object, DataFrame]:
    """The sequence classifier of the 50 largest instruments, and its stored samples, the last tenth of them held out."""
    window = i.bars_since(readers.TRAIN_DAYS)
    closes = series.latest(window, ["close"]).withColumnRenamed("close", "last_close")
    chosen = seq.top_by_market_cap(i.tradable, closes)
    placed = materialise(seq.tail_split(training.sequence_samples(window, chosen, i.as_of)), "samples")
    return seq.train_sequence_model(placed.where(~F.col("is_tail")), epochs=20), placed


@query
def dl_trend_score(i: Inputs) -> DataFrame:
    """Trend score of every instrument; the classifier learns from the 50 largest ones."""
    model, _ = trend_model(i)
    return seq.trend_scores(model, seq.newest_sequences(i.bars_since(readers.TRAIN_DAYS)))


@query
def trend_accuracy(i: Inputs) -> DataFrame:
    """Share of right predictions on the held-out tail of the samples."""
    model, placed = trend_model(i)
    return seq.sequence_accuracy(model, placed.where("is_tail"))


# --- news --------------------------------------------------------------------------------------


@query
def latest_headlines(i: Inputs) -> DataFrame:
    return sentiment.latest_headlines(i.headlines, i.as_of).select("ticker", "rn", "seq", "title")


@query
def headline_labels(i: Inputs) -> DataFrame:
    """The word rule over every headline."""
    found = sentiment.classified(i.headlines.select("ticker", "seq", "title"))
    return rounded(found.select("ticker", "seq", "label", "score"), 6, "score")


def _learned(i: Inputs) -> tuple[DataFrame, Column]:
    """The word model of two thirds of the labelled documents, and which headlines were held out."""
    held = F.substring(F.md5(F.col("seq").cast("string")), 1, 1).isin(list("01234"))
    told = derived.labelled_headlines(i.spark, i.sf_dir)
    return materialise(sentiment.learn_words(told.where(~held)), "word-model"), held


@query
def headline_bayes(i: Inputs) -> DataFrame:
    """Label and log odds of every headline by the learned words."""
    model, _ = _learned(i)
    return rounded(sentiment.judged(i.headlines.select("seq", "title"), model), 4, "log_odds")


@query
def headline_accuracy(i: Inputs) -> DataFrame:
    """Held-out headlines of each label that the learned words get right."""
    model, held = _learned(i)
    told = derived.labelled_headlines(i.spark, i.sf_dir).where(held)
    found = sentiment.judged(told.select("seq", "title"), model).withColumnRenamed("label", "found")
    met = told.select("seq", "label").join(found, "seq")
    return met.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == F.col("found")).alias("right"))


@query
def sentiment_points(i: Inputs) -> DataFrame:
    points = sentiment.points(F.col("label"), F.col("score"))
    return rounded(i.headlines.select("ticker", "seq", points.alias("points")), 6, "points")


def _sentiment(i: Inputs) -> DataFrame:
    return sentiment.sentiment(i.listing.select("ticker"), sentiment.latest_headlines(i.headlines, i.as_of))


@query
def sentiment_score(i: Inputs) -> DataFrame:
    return _sentiment(i).select("ticker", "sentiment_score")


@query
def headlines_joined(i: Inputs) -> DataFrame:
    return _sentiment(i).select("ticker", "headlines")
