"""Headlines are read in one pass."""

from __future__ import annotations

from quantloom.operators import sentiment


def test_titles_are_cut_once(spark):
    """Titles are cut into words once, for lengths and evidence; a repeated key is judged by the words of all its rows."""
    told = spark.createDataFrame([("up gain", "good"), ("down loss", "bad")], "title string, label string")
    model = sentiment.learn_words(told)
    model = spark.createDataFrame(model.collect(), model.schema)
    asked = spark.createDataFrame([(1, "up up down"), (2, "gain"), (2, "loss loss"), (3, None), (None, "up")], "seq long, title string")
    found = sentiment.judged(asked, model)
    assert sorted((r.seq or 0, r.label) for r in found.collect()) == [(0, "bad"), (1, "good"), (2, "bad"), (2, "bad"), (3, "bad")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate explode(regexp_extract_all") == 1
