"""Languages that few documents declare, and declarations with region or script."""

from __future__ import annotations

import random

from quantloom.llm import language


def _text(draw, name):
    return " ".join(f"{name}{'abcdefghij'[draw.randrange(10)]}{'klmnopqrst'[draw.randrange(10)]}{name}" for _ in range(60))


def _languages(spark, rows, column="lang"):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    return {r.doc_id: r[column] for r in language.languages_of(docs, pages).collect()}


def test_rare_language_and_subtags(spark):
    draw = random.Random(1)
    tags = ["en-US", "EN", "en_GB", "pt_BR", "pt-PT", "zh-Hans", "zh"]
    names = {"e": "vex", "p": "qui", "z": "mok"}
    rows = [(i, _text(draw, names[tags[i % 7][0].lower()]), tags[i % 7]) for i in range(3000)]
    rows += [(3000, _text(draw, "sul"), "fi"), (3001, _text(draw, "sul"), "fi-FI"), (3002, _text(draw, "sul"), None)]
    rows += [(3003, _text(draw, "vex"), "und")]
    got = _languages(spark, rows)
    assert all(got[i] == tags[i % 7][:2].lower() for i in range(3000))
    assert [got[i] for i in range(3000, 3004)] == ["fi", "fi", "fi", "en"]


def test_table_with_regions_only(spark):
    draw = random.Random(2)
    got = _languages(spark, [(i, _text(draw, "vex" if i % 2 else "qui"), "en-US" if i % 2 else "pt_BR") for i in range(40)])
    assert got == {i: "en" if i % 2 else "pt" for i in range(40)}


def test_unknown_words_do_not_speak_for_the_smallest_language(spark):
    draw = random.Random(3)
    rows = [(i, _text(draw, "vex"), "en") for i in range(300)] + [(300, _text(draw, "sul"), "fi")]
    rows += [(400 + i, " ".join(f"{draw.randrange(10**9)}x{chr(97 + draw.randrange(26)) * 9}{i}" for _ in range(3)), None) for i in range(20)]
    got = _languages(spark, rows, "text_lang")
    assert got[300] == "fi" and sum(got[400 + i] == "fi" for i in range(20)) < 10
