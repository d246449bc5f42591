"""Small frames with every odd case: NULLs, empty, blank and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while nobody in the old house was looking at all " * 4
DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, copies long, block string, `row` string, kept string"
)


def odd_documents() -> list[tuple]:
    long_text = " ".join(f"w{i % 5000}x{i}" for i in range(20_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, "one  two"), (7, "one two"), (7, "one two"),
        (8, PROSE), (9, PROSE.replace(" ", "\n")), (10, PROSE + "extra"), (None, PROSE), (None, None), (11, long_text),
        (12, long_text + " tail"), (13, "Ünï çödé ΑΣ 中文 😀 <|endoftext|> x"), (14, "a b c " * 60), (15, "### *** $$$ %%% " * 20),
        (16, "Licensed under the Apache License, Version 2.0. Copyright 2020 X.\nSome license of ours."),
    ]
    return [
        (i, t, [None, "en", "de"][k % 3], [None, "", "a", "b"][k % 4], None, 7, "x", "y", None) for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(8, 1, 0), (8, 1, 0), (8, None, 0), (9, 1, 0), (10, 1, 0), (15, 0, 0), (14, 0, None), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
