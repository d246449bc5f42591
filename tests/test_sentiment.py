import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.operators import sentiment

AS_OF = dt.date(2024, 5, 10)


def _headlines(spark, rows):
    return spark.createDataFrame(
        [(t, AS_OF - dt.timedelta(days=age), seq, title) for t, age, seq, title in rows],
        "ticker string, date date, seq long, title string",
    )


def _listing(spark, tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_newest_five_of_three_days(spark):
    rows = [("A", age, seq, f"{age}-{seq}") for age in range(6) for seq in (2, 1)]
    got = sentiment.latest_headlines(_headlines(spark, rows), AS_OF).orderBy("rn").collect()
    assert [r["title"] for r in got] == ["0-1", "0-2", "1-1", "1-2", "2-1"]


def test_limit_comes_before_the_shuffle(spark):
    rows = [("A", 0, i, str(i)) for i in range(50)]
    plan = sentiment.latest_headlines(_headlines(spark, rows), AS_OF)._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.split("Exchange hashpartitioning")[-1]
    assert "WindowGroupLimit" in before_exchange


def test_points_and_defaults(spark):
    labelled = spark.createDataFrame(
        [
            ("A", 1, "good", "positive", 0.8),
            ("A", 2, "bad", "negative", 0.5),
            ("A", 3, "odd", "mixed", 0.9),
            ("B", 1, "odd", "mixed", 0.9),
        ],
        "ticker string, rn int, title string, label string, score double",
    )
    got = {r["ticker"]: tuple(r)[1:] for r in sentiment.sentiment(_listing(spark, "ABC"), labelled).collect()}
    assert got == {
        "A": (57.5, "good | bad | odd"),
        "B": (50.0, "odd"),
        "C": (50.0, sentiment.NO_NEWS),
    }


@pytest.mark.parametrize(
    ("title", "label"),
    [("Record profit", "positive"), ("Shares fall on weak sales", "negative"), ("again gain, loss", "neutral"), ("", "neutral")],
)
def test_word_rule(spark, title, label):
    row = sentiment.classified(_headlines(spark, [("A", 0, 1, title)])).first()
    assert row["label"] == label and 0.5 <= row["score"] <= 1


def test_model_is_pluggable(spark):
    def load():
        return lambda titles: [("positive", 1.0) if "+" in t else ("negative", 0.5) for t in titles]

    heads = _headlines(spark, [("A", 0, 1, "+"), ("A", 0, 2, "-")])
    found = sentiment.classified(sentiment.latest_headlines(heads, AS_OF), sentiment.model_classifier(load))
    assert sentiment.sentiment(_listing(spark, "A"), found).first()["sentiment_score"] == 62.5
    neutral = sentiment.classified(sentiment.latest_headlines(heads, AS_OF), sentiment.neutral_classifier)
    assert sentiment.sentiment(_listing(spark, "A"), neutral).first()["sentiment_score"] == 50.0


def test_model_never_sees_a_missing_title(spark):
    def load():
        return lambda titles: [("positive", float(len(t))) for t in titles]

    heads = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "seq long, title string")
    got = {r["seq"]: (r["label"], r["score"]) for r in sentiment.classified(heads, sentiment.model_classifier(load)).collect()}
    assert got == {1: ("positive", 2.0), 2: ("neutral", 1.0), 3: ("positive", 0.0)}


def test_one_busy_ticker(spark):
    heads = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 500)).alias("ticker"),
        F.lit(AS_OF).alias("date"),
        F.col("id").alias("seq"),
        F.lit("x").alias("title"),
    )
    got = sentiment.latest_headlines(heads, AS_OF).groupBy("ticker").agg(F.max("seq").alias("m"), F.count("*").alias("n"))
    hot = got.where("ticker = 'HOT'").first()
    assert (hot["m"], hot["n"]) == (12, 5)


def _bayes(told, titles):
    """Multinomial Bayes over hashed words, in plain Python."""
    bucket = lambda w: hashlib.md5(w.encode()).hexdigest()[:4]
    words = lambda t: [bucket(w) for w in re.findall("[a-zà-ÿ]+", (t or "").lower())]
    counts, rows = {}, Counter(label for _, label in told)
    for title, label in told:
        counts.setdefault(label, Counter()).update(words(title))
    out = []
    for title in titles:
        scores = []
        for label in rows:
            total = sum(counts[label].values()) + sentiment.TOKEN_BUCKETS
            scores.append((math.log(rows[label] / len(told)) + sum(math.log((counts[label][b] + 1) / total) for b in words(title)), label))
        scores.sort(key=lambda s: (-s[0], s[1]))
        out.append((scores[0][1], scores[0][0] - scores[1][0]))
    return out


def test_learned_words_equal_plain_bayes(spark):
    rng = random.Random(3)
    draw = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    good, bad, other = ["up", "gain", "höher", "the"], ["down", "loss", "the"], ["report", "the", "on"]
    told = [(draw(w, rng.randint(1, 12)).title(), label) for w, label in [(good, "positive"), (bad, "negative"), (other, "neutral")] * 30]
    told += [(None, "neutral"), ("", "neutral")]
    titles = [draw(good + bad + other, rng.randint(1, 9)) for _ in range(40)] + [None, "", "unheard of words", "the " * 500]
    model = sentiment.learn_words(spark.createDataFrame(told, "title string, label string"))
    asked = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")
    got = {r.seq: (r.label, r.log_odds) for r in sentiment.judged(asked, model).collect()}
    for i, (label, odds) in enumerate(_bayes(told, titles)):
        assert got[i][0] == label and got[i][1] == pytest.approx(odds, abs=1e-9)
    assert sentiment.judged(asked.limit(0), model).count() == 0
