"""Jobs for spark-submit: code-map, train, train-sequences and rank."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import forest, sentiment, series
from quantloom.operators import sequences as seq
from quantloom.operators.blend import display
from quantloom.plans import serving, training
from quantloom.sources import readers
from quantloom.storage import materialise


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("code-map", help="keep the listed companies of a company file")
    job.add_argument("--companies", required=True)
    job.add_argument("--out", required=True)

    def add(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        job = jobs.add_parser(name, help=text)
        for path in paths:
            job.add_argument(f"--{path}", required=True)
        job.add_argument("--as_of", type=dt.date.fromisoformat, help="result date; default: the last bar")
        job.add_argument("--excluded", default=readers.EXCLUDED_NAMES, help="pattern of names to leave out")
        job.add_argument("--one_bar_a_day", action="store_true", help="(ticker, date) is unique in the bars")
        return job

    tables = ("listing", "code_map", "bars", "statements")
    job = add("train", "train and store the random forest", *tables, "model")
    job.add_argument("--n_jobs", type=int, default=4, help="fits that run at the same time")
    job.add_argument("--n_iter", type=int, default=forest.DRAWS)
    job.add_argument("--max_depth", type=int, nargs="+", default=list(forest.DEPTHS))
    job.add_argument("--trees", type=int, nargs=2, default=list(forest.TREES))
    job.add_argument("--split", choices=("stratified", "time"), default="stratified")
    job.add_argument("--balance", choices=("smote", "weight", "none"), default="smote")
    job.add_argument("--lag_years", type=int, choices=(0, 1), default=0)

    job = add("train-sequences", "train and store the sequence classifier", "listing", "bars", "model")
    job.add_argument("--epochs", type=int, default=20)
    job.add_argument("--tickers", nargs="+", help="fixed instruments instead of the largest ones")

    job = add("rank", "rank all instruments", *tables, "model", "out")
    job.add_argument("--sequence_model")
    job.add_argument("--headlines")
    return parser


def _bars(spark: SparkSession, args: argparse.Namespace, days: int) -> tuple[DataFrame, dt.date]:
    as_of = args.as_of or readers.as_of_date(readers.read_bars(spark, args.bars))
    return readers.read_stored_bars(spark, args.bars, readers.days_before(as_of, days), as_of), as_of


def train(spark: SparkSession, args: argparse.Namespace) -> forest.Trained:
    bars, as_of = _bars(spark, args, readers.TRAIN_DAYS)
    history = training.feature_history(
        readers.read_listing(spark, args.listing),
        readers.read_code_map(spark, args.code_map),
        bars,
        readers.read_statements(spark, args.statements, training.statement_years(as_of)),
        as_of,
        args.excluded,
        args.lag_years,
        args.one_bar_a_day,
    )
    trained = forest.train_forest(
        training.training_rows(history),
        training.FEATURES,
        n_iter=args.n_iter,
        depths=args.max_depth,
        trees=tuple(args.trees),
        parallelism=args.n_jobs,
        split=args.split,
        balance=args.balance,
    )
    forest.save_model(trained.model, args.model)
    print(f"cross-validated AUC {trained.cv_auc:.4f} with {trained.params}")
    print(f"held-out AUC {trained.auc.first()['auc']:.4f}")
    trained.report.show()
    return trained


def train_sequences(spark: SparkSession, args: argparse.Namespace) -> None:
    bars, as_of = _bars(spark, args, readers.TRAIN_DAYS)
    listing = readers.tradable(readers.read_listing(spark, args.listing), args.excluded)
    if args.tickers:
        chosen = listing.where(F.col("ticker").isin(args.tickers))
    else:
        closes = series.latest(bars, ["close"]).withColumnRenamed("close", "last_close")
        chosen = seq.top_by_market_cap(listing, closes)
    samples = training.sequence_samples(bars, chosen, as_of)
    placed = materialise(seq.tail_split(samples), "samples")
    model = seq.train_sequence_model(placed.where(~F.col("is_tail")), epochs=args.epochs)
    seq.save_sequence_model(model, args.model)
    seq.sequence_accuracy(model, placed.where("is_tail")).show()


def rank(spark: SparkSession, args: argparse.Namespace) -> None:
    model = forest.load_model(args.model)
    bars, as_of = _bars(spark, args, readers.SERVE_DAYS)
    listing = readers.read_listing(spark, args.listing)
    extra = {}
    if args.sequence_model:
        history, _ = _bars(spark, args, readers.TRAIN_DAYS)
        newest = seq.newest_sequences(readers.in_range(history, readers.days_before(as_of, readers.TRAIN_DAYS), as_of))
        extra["dl_trend_score"] = seq.trend_scores(seq.load_sequence_model(args.sequence_model), newest)
    if args.headlines:
        newest = sentiment.latest_headlines(readers.read_headlines(spark, args.headlines), as_of)
        extra["sentiment_score"] = sentiment.sentiment(listing.select("ticker"), sentiment.classified(newest))
    ranked = serving.rank_universe(
        listing,
        readers.read_code_map(spark, args.code_map),
        bars,
        readers.read_statements(spark, args.statements, [as_of.year - 1]),
        as_of,
        predict=lambda universe: forest.score_instruments(model, universe),
        extra_scores=extra,
        excluded=args.excluded,
        one_bar_a_day=args.one_bar_a_day,
    )
    readers.write_result(display(ranked), args.out)


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quantloom-{args.job}").getOrCreate()
    if args.job == "code-map":
        companies = spark.read.schema(readers.COMPANY_SCHEMA).option("header", True).csv(args.companies)
        readers.write_code_map(readers.build_code_map(companies), args.out)
    elif args.job == "train":
        train(spark, args)
    elif args.job == "train-sequences":
        train_sequences(spark, args)
    else:
        rank(spark, args)


if __name__ == "__main__":
    main()
