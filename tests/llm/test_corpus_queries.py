"""Every corpus query on the smallest tables: against its SQL, or against a brute-force version."""

from __future__ import annotations

import html
import re
from collections import Counter

import pytest
from check import connect, differences
from conftest_corpus import brute_pipeline, library_digests
from pyspark.sql import functions as F

from quantloom.llm import classifier, language
from quantloom.llm.catalog import CORPUS_ORACLES, CORPUS_QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(CORPUS_ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = CORPUS_QUERIES[name](spark, SMALL).toPandas()
    assert not differences(got, duck.execute(CORPUS_ORACLES[name]).df())


def test_extraction_equals_the_articles_of_the_pages(spark):
    got = CORPUS_QUERIES["op5_html_extraction"](spark, MIDDLE).toPandas()
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").toPandas()
    want = {}
    for page in pages.itertuples():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        want[page.page_id] = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
    assert dict(zip(got.page_id, got.text, strict=True)) == want
    assert (got.n_chars == got.text.str.len()).all()


def test_encoding_equals_the_library(spark):
    got = CORPUS_QUERIES["op7_bpe"](spark, SMALL).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got.itertuples(index=False)] == library_digests(docs.doc_id.tolist(), docs.text.tolist())


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    judged = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(judged) > 50
    assert (judged.predicted == judged.quality).mean() > 0.97


def test_language_of_unseen_texts_and_of_pages(spark):
    docs, pages = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "pages"))
    # Half of the documents lose their declaration: they are identified by text, source and prior alone.
    hidden = F.col("doc_id") % 2 == 0
    got = language.languages_of(docs.withColumn("lang", F.when(~hidden, F.col("lang"))), pages).toPandas()
    truth = docs.toPandas().set_index("doc_id").lang
    unseen = got[got.doc_id.notna() & (got.doc_id % 2 == 0)]
    assert (unseen.lang == unseen.doc_id.map(truth)).mean() > 0.97
    markup = pages.toPandas().set_index("page_id").html.str.extract(r'<html lang="(..)"')[0]
    of_pages = got[got.page_id.notna()]
    assert len(of_pages) == len(markup)
    assert (of_pages.lang == of_pages.page_id.map(markup)).mean() > 0.97


def test_pipeline_equals_brute_force(spark):
    got = CORPUS_QUERIES["pipeline"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    kept = CORPUS_QUERIES["op2_quality_rules"](spark, SMALL).where("kept").toPandas().doc_id
    want = brute_pipeline(docs[docs.doc_id.isin(kept)])
    assert Counter(got.itertuples(index=False, name=None)) == Counter(want)


def test_catalogue_is_whole():
    assert [n for n in CORPUS_QUERIES if n.startswith("op")] and len({n.split("_")[0] for n in CORPUS_QUERIES}) == 14
