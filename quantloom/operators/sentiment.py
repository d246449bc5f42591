"""News sentiment per instrument."""

from __future__ import annotations

import datetime as dt
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import round_half_even
from quantloom.sources.readers import NEWS_DAYS, days_before

# The classifier wrapper travels with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Headlines per instrument, neutral score, separator and the text without news.
HEADLINES_PER_TICKER = 5
NEUTRAL_POINTS = 50.0
SEPARATOR = " | "
NO_NEWS = "최신 뉴스 없음"

RESULT = "struct<label: string, score: double>"
# Words of the simple rule; a trained model replaces it through `model_classifier`.
POSITIVE_WORDS = ("gain", "growth", "profit", "record", "rise", "strong")
NEGATIVE_WORDS = ("decline", "default", "fall", "loss", "lawsuit", "weak")


def latest_headlines(
    headlines: DataFrame, as_of: dt.date, days: int = NEWS_DAYS, limit: int = HEADLINES_PER_TICKER
) -> DataFrame:
    """The newest headlines of the last days, numbered by `rn` per ticker.

    The limit on the row number is applied before the shuffle too, so an instrument with very many
    headlines sends at most `limit` rows per input partition.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"), "seq")
    recent = headlines.where(F.col("date").between(F.lit(days_before(as_of, days)), F.lit(as_of)))
    return recent.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)


def neutral_classifier(title: Column) -> Column:
    """The answer when no model is available."""
    return F.struct(F.lit("neutral").alias("label"), F.lit(1.0).alias("score"))


def _any_word(words: Sequence[str]) -> Column:
    """The listed words and their plain inflections, as whole words."""
    return F.lit(f"(?<![a-z])(?:{'|'.join(words)})(?:s|es|ed|ing)?(?![a-z])")


def word_classifier(
    title: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """Label by the balance of listed words; score = share of the winning side."""
    text = F.lower(title)
    up = F.regexp_count(text, _any_word(positive)).cast("double")
    down = F.regexp_count(text, _any_word(negative)).cast("double")
    label = F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.coalesce(F.try_divide(F.greatest(up, down), up + down), F.lit(1.0)).alias("score"))


def model_classifier(
    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
) -> Callable[[Column], Column]:
    """Wrap a trained model: `load` runs once per Python worker, the model gets whole Arrow batches of titles.

    Missing titles never reach the model; they are neutral.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Workers outlive tasks, and so does what hangs on a module that every worker has.
        loaded = sys.__dict__.setdefault("_quantloom_models", {})
        if name not in loaded:
            loaded[name] = load()
        for titles in batches:
            known = titles.notna()
            out = pd.DataFrame({"label": "neutral", "score": 1.0}, index=titles.index)
            if known.any():
                out.loc[known, ["label", "score"]] = loaded[name](titles[known].tolist())
            yield out

    return classify


# --- a classifier learned from labelled headlines -----------------------------------------------

# Buckets of tokens, named by the first digits of a hash: the model has at most this many rows for each label.
TOKEN_BUCKETS = 1 << 16


def token_buckets(headlines: DataFrame, *keep: str) -> DataFrame:
    """(keep.., bucket): the bucket of every word of a headline; a missing title has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("([a-zà-ÿ]+)"), 1)
    return headlines.select(*keep, F.explode(words).alias("word")).select(*keep, F.substring(F.md5("word"), 1, 4).alias("bucket"))


def learn_words(labelled: DataFrame) -> DataFrame:
    """(label, bucket, evidence): multinomial Bayes of the labelled headlines (title, label), smoothed by one.

    The row of a label without a bucket holds its log prior and the evidence of an unseen bucket (`unseen`), any other row
    what its bucket adds to that. Counts are combined before they are shuffled; the model is bounded by the buckets.
    """
    counts = token_buckets(labelled, "label").groupBy("label", "bucket").agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    priors = labelled.groupBy("label").agg(F.count("*").alias("rows"))
    all_rows = priors.agg(F.sum("rows").alias("all"))
    unseen = -F.log(F.coalesce("total", F.lit(0)) + TOKEN_BUCKETS)
    heads = priors.join(totals, "label", "left").crossJoin(F.broadcast(all_rows)).select(
        "label", F.lit(None).cast("string").alias("bucket"), F.log(F.col("rows") / F.col("all")).alias("evidence"), unseen.alias("unseen")
    )
    seen = counts.select("label", "bucket", F.log(F.col("n") + 1).alias("evidence"), F.lit(None).cast("double").alias("unseen"))
    return heads.unionByName(seen)


def judged(headlines: DataFrame, model: DataFrame, key: str = "seq") -> DataFrame:
    """(key, label, log_odds): the likeliest label of each headline, and its lead over the next in log odds.

    Built-in functions only: the words of a headline meet the model (its size is bounded, so it is broadcast) and their
    evidence is added up label by label where the words are, in one pass: only sums are shuffled. Ties go to the first label in order; a headline
    without words is judged by the priors. Labels without a single example are never given.
    """
    heads = model.where("bucket IS NULL").select("label", F.col("evidence").alias("prior"), "unseen")
    labels = heads.agg(F.sort_array(F.collect_list(F.struct("label", "prior", "unseen"))).alias("labels"))  # one entry for each label
    seen = model.where("bucket IS NOT NULL").groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("label", "evidence"))).alias("evidence"))
    words = token_buckets(headlines, key).join(F.broadcast(seen), "bucket", "left")
    # The entry without a label counts the words, so that one pass gives both.
    length = F.struct(F.lit(None).cast("string").alias("key"), F.lit(1.0).alias("value"))
    entry = F.explode(F.concat(F.array(length), F.map_entries(F.coalesce("evidence", F.create_map().cast("map<string,double>"))))).alias("e")
    told = words.select(key, entry).groupBy(key, F.col("e.key").alias("label")).agg(F.sum("e.value").alias("told"))
    told = told.groupBy(key).agg(
        F.max(F.when(F.col("label").isNull(), F.col("told"))).alias("length"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "told")))).alias("told"),
    )
    met = headlines.select(key).join(told, key, "left").crossJoin(F.broadcast(labels))
    known = F.coalesce("told", F.create_map().cast("map<string,double>"))
    total = F.transform(
        "labels",
        lambda x: F.struct(
            (x["prior"] + F.coalesce("length", F.lit(0)) * x["unseen"] + F.coalesce(F.try_element_at(known, x["label"]), F.lit(0.0))).alias("score"),
            x["label"].alias("label"),
        ),
    )
    ordered = F.array_sort(total, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    return met.select(key, ordered.alias("o")).select(
        key, F.get("o", F.lit(0))["label"].alias("label"), (F.get("o", F.lit(0))["score"] - F.get("o", F.lit(1))["score"]).alias("log_odds")
    )


def classified(headlines: DataFrame, classifier: Callable[[Column], Column] = word_classifier) -> DataFrame:
    """Add label and score of every headline."""
    found = headlines.withColumn("_result", classifier(F.col("title")))
    return found.select(*headlines.columns, "_result.label", "_result.score")


def points(label: Column, score: Column) -> Column:
    """0..100: neutral 50, positive above, negative below; any other label does not count."""
    return (
        F.when(label == "neutral", F.lit(NEUTRAL_POINTS))
        .when(label == "positive", NEUTRAL_POINTS + score * 50)
        .when(label == "negative", NEUTRAL_POINTS - score * 50)
    )


def sentiment(listing: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every instrument with its sentiment score and joined headlines; 50 and a fixed text without news.

    `labelled` has ticker, rn, title, label and score, at most a handful of rows per ticker.
    """
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"])
    news = labelled.groupBy("ticker").agg(
        F.avg(points(F.col("label"), F.col("score"))).alias("_points"),
        F.array_join(titles, SEPARATOR).alias("_titles"),
    )
    return listing.join(news, "ticker", "left").select(
        *listing.columns,
        round_half_even(F.coalesce("_points", F.lit(NEUTRAL_POINTS))).alias("sentiment_score"),
        F.coalesce("_titles", F.lit(NO_NEWS)).alias("headlines"),
    )
