"""Defined results for NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from conftest_corpus import jaccard_classes, library, library_digests
from pyspark.sql import functions as F

from quantloom.llm import bpe, classifier, exact, jaccard, language, licenses, mixing, quality_rules
from quantloom.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_rules(spark, odd, odd_labels, none):
    found = {r.row.doc_id: r for r in quality_rules.quality_verdicts(odd, odd_labels).collect()}
    assert len(found) == len({r.doc_id for r in odd.collect()})
    for empty in (1, 2, 3):
        assert (found[empty].n_words, found[empty].base_failed, found[empty].kept, found[empty].ratio) == (0, True, False, 0.0)
    # Three words again and again: every word is covered by a window that recurs.
    assert found[14].n_repeat_words == found[14].n_words == 180 and found[14].base_failed
    assert found[15].n_symbols == 240
    assert found[11].n_words == 20_000 and found[11].n_repeat_words == 0
    good = quality_rules.good_documents(odd, odd_labels)
    assert good.columns == odd.columns
    assert quality_rules.good_documents(none, odd_labels).count() == 0
    # Without labels nothing is held against a text but the base rules.
    blind = quality_rules.quality_verdicts(odd, odd_labels.limit(0)).collect()
    assert all(abs(r.ratio) < 1e-12 and r.kept != r.base_failed for r in blind)


def test_quality_plan_never_copies_the_weights(spark, odd, odd_labels):
    for frame in (quality_rules.quality_verdicts(odd, odd_labels), quality_rules.good_documents(odd, odd_labels)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("scalar-subquery") >= 5 and not re.search(r"scalar-subquery#\d+ \[\](\.\w+)? AS (weights|target|scale|means)", plan)


def test_repeats_by_words_equal_repeats_by_hashes(spark, odd, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c x a b c"), (2, "a a a a"), (3, "a b c d e f g h a b c d")], "doc_id long, text string")
    packed_rows = texts.unionByName(odd.select("doc_id", "text")).select(F.struct("*").alias("row"), F.lit(False).alias("trusted"))
    counts = lambda: sorted((r.row.doc_id or 0, r.n_repeat_words) for r in quality_rules.base_counts(packed_rows).collect())
    by_hashes = counts()
    assert {(1, 6), (2, 4), (3, 8)} <= set(by_hashes)
    monkeypatch.setattr(quality_rules, "PLACES", 4)
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 2)
    assert counts() == by_hashes


def _prose(rng, vocabulary, words):
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def _corpus():
    """Clean texts in a labelled and an unlabelled language, and junk in both; half of the clean labelled ones are labelled."""
    rng = random.Random(5)
    english = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    other = ["".join(rng.choice("mnopqrst") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    junk = ["$" + "".join(rng.choice("wxyz") for _ in range(4)) for _ in range(40)]
    rows = [(i, _prose(rng, english, 80 + i % 60), "en") for i in range(300)]
    rows += [(1000 + i, _prose(rng, other, 80 + i % 60), "xx") for i in range(150)]
    rows += [(2000 + i, _prose(rng, junk, 80 + i % 60), "en") for i in range(30)]
    return rows, [(i, 1, 0) for i in range(0, 300, 2)] + [(2000 + i, 0, 0) for i in range(5)]


def test_quality_verdicts_leave_clean_texts_of_any_language_alone(spark):
    rows, labels = _corpus()
    judge = lambda rows, labels: {
        r.row.doc_id: r
        for r in quality_rules.quality_verdicts(
            spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        ).collect()
    }
    found = judge(rows, labels)
    for i, r in found.items():
        assert r.kept == (i < 2000), (i, r.ratio)
    # A label can't vouch for its own text: junk that is labelled as good is still rejected.
    fooled = judge(rows, [*labels, (2029, 1, 0)])
    assert not fooled[2029].kept
    # The same texts under other ids, with the same labels: twice the corpus, the same scores but for what a text's twin says of it.
    twice = judge([*rows, *((i + 10_000, t, lang) for i, t, lang in rows)], [*labels, *((i + 10_000, q, x) for i, q, x in labels)])
    assert all(twice[i].kept == r.kept for i, r in found.items())
    untold = [i for i in found if i % 2 or i >= 1000]
    assert max(abs(twice[i].ratio - found[i].ratio) for i in untold) < 1e-9


def test_exact_groups(odd, none):
    found = _rows(exact.exact_groups(odd, salts=4))
    want = {}
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in odd.collect()]
    for i, t in rows:
        want.setdefault(t, []).append(i)
    expected = []
    for i, t in rows:
        ids = [x for x in want[t] if x is not None]
        keep = min(ids) if ids else None
        expected.append((i, keep, len(want[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert found == sorted(expected, key=repr)
    kept = exact.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({e[0] for e in expected if e[3]})
    assert exact.exact_groups(none).count() == exact.deduplicated(none).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard(odd, none, width, percent):
    found = jaccard.jaccard_components(odd, width, percent).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    label, _ = jaccard_classes(list({i: (i, t) for i, t in rows if i is not None}.values()), width, percent)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == label
    assert all(r.component_id is None and r.n_links == 0 for r in found if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in found}[4] == 1
    assert jaccard.jaccard_components(none, width, percent).count() == 0
    stay = jaccard.one_of_each_group(odd, width, percent)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.where("doc_id IS NOT NULL").collect()) == sorted({i for i in label if label[i] == i})


def test_jaccard_of_a_large_family(spark):
    """Near copies far beyond the size of a group, with and without links, and a passage that most texts share."""
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(300):
        words = base.copy()
        words[i % 97] = f"own{i}"
        if i % 2:
            words[(7 * i) % 89] = f"other{i}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"q{k}_{i}" for i in range(30)) for k in range(100)]
    rows = list(enumerate(texts))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    label, links = jaccard_classes(rows, 3, 90)
    assert {r.doc_id: (r.component_id, r.n_links) for r in found} == {i: (label[i], links[i]) for i in label}
    assert max(links.values()) > 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 5), (5, 1), (5, 5)], "u long, v long")
    assert dict(map(tuple, components(edges).collect())) == {i: 100 for i in range(101, 161)} | {5: 1}


def test_encoding(odd, none):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert _rows(bpe.encoding_digests(odd, TOKENIZER)) == sorted(library_digests(*map(list, zip(*texts, strict=True))), key=repr)
    tokenizer = library()
    for row in bpe.encoded(odd.where("doc_id IN (1, 13, 16)"), TOKENIZER).collect():
        assert row.decoded == tokenizer.decode(row.ids, skip_special_tokens=False)
    assert bpe.encoding_digests(none, TOKENIZER).count() == bpe.encoded(none, TOKENIZER).count() == 0


def test_encoding_of_unusual_characters():
    import random

    draw = random.Random(5)
    alphabet = "aAbB ÇéßΣσς́\u0085\u001c 'stTlLdDvVeE0½²٣क中😀_-.!?<|>ffiİıŁ\n\t"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 50))) for _ in range(2000)] + ["A" * 3000]
    tokenizer = bpe.WordEndTokenizer(open(TOKENIZER, encoding="utf-8").read())
    lib = library()
    for text, (n, data, decoded), want in zip(
        texts, tokenizer.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True
    ):
        assert n == len(want.ids)
        assert decoded == lib.decode(want.ids, skip_special_tokens=False) == tokenizer.decode(data), text


def test_mixing(spark, odd, none):
    counted = mixing.copies_of_each(odd, repeat_limit=3.0, block_tokens=50)
    assert counted.count() == odd.count()
    mixture = mixing.mixed(odd, repeat_limit=3.0, block_tokens=50)
    assert mixture.columns == odd.columns
    assert mixture.count() == counted.agg(F.sum("copies")).first()[0]
    assert counted.where("copies < 1").count() == 0
    assert mixing.mixed(none, repeat_limit=3.0).count() == 0
    with pytest.raises(ValueError):
        mixing.copies_of_each(odd)


def test_mixing_meets_targets(spark):
    rows = [(k * 1000 + i, "w " * (5 + i % 7), f"s{k}") for k, n in enumerate((600, 200, 40)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limited = mixing.copies_of_each(docs, repeat_limit=4.0, block_tokens=300)
    per = {r.source: r.t / r.n for r in limited.groupBy("source").agg(F.sum(F.expr("copies * n_tokens")).alias("t"), F.sum("n_tokens").alias("n")).collect()}
    assert per["s0"] == 1 and 3.5 < per["s2"] <= 4.0
    weights = [r.weight for r in mixing.copies_of_each(docs, target_entropy=0.9).select("source", "weight").distinct().collect()]
    import math

    assert abs(-sum(w * math.log(w) for w in weights) - 0.9) < 1e-6
    bounded = mixing.copies_of_each(docs, target_entropy=1.0, budget=3000, block_tokens=300)
    used = bounded.agg(F.sum(F.expr("copies * n_tokens"))).first()[0]
    assert 2900 < used <= 3000


def test_classifier(odd, odd_labels, none):
    scored = classifier.quality_scores(odd, odd_labels).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0.5 and r.predicted == 1 for r in classifier.quality_scores(odd, odd_labels.limit(0)).collect())
    one_kind = classifier.quality_scores(odd, odd_labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one_kind) == 1 and one_kind[0].score > 0.5
    assert classifier.quality_scores(none, odd_labels).count() == 0


def test_tree_rules():
    printed = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 0 <= 0.5)\n      Predict: 1.0\n     Else (feature 0 > 0.5)\n      Predict: 0.0\n    Else (feature 0 > 1.5)\n     Predict: 0.0\n"
    assert classifier.tree_rules(printed, ["x"]) == {
        (("x", True, 1.5),), (("x", True, 0.5),), (("x", False, 0.5), ("x", True, 1.5)), (("x", False, 1.5),),
    }


def test_licenses(spark, odd, none):
    found = {r.doc_id: r for r in licenses.license_scan(odd).collect()}
    assert found[16].licenses == ["Apache-2.0"] and found[16].n_unknown == 1
    assert found[16].sentence_ids == ["apache-2-name", "copyright", "unknown"]
    assert found[1].licenses == found[2].licenses == []
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided it holds.\n"
        "Redistributions of source code must retain the above copyright notice.\n"
        "Redistributions in binary form must reproduce the above copyright notice.\n"
    )
    third = "Neither the name of the holder nor its contributors may be used to endorse products without permission.\n"
    rows = [(1, bsd + third), (2, bsd), (3, bsd.replace("source code must", "code must"))]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["BSD-3-Clause"], 2: ["BSD-2-Clause"], 3: []}
    assert licenses.license_scan(none).count() == 0


def test_languages(spark, odd, none):
    pages = spark.createDataFrame([(1, None, None), (2, "::", ""), (2, "http://a.b.de/", '<html lang="DE"><p>und')], "page_id long, url string, html string")
    found = language.languages_of(odd, pages).collect()
    assert len(found) == odd.count() + 3
    assert {r.lang for r in found} <= {"en", "de"} and all(0.5 <= r.probability <= 1 for r in found)
    assert all(r.lang is None for r in language.languages_of(none, pages).collect())
    assert language.languages_of(none, pages.limit(0)).count() == 0


def test_a_family_makes_few_groups(spark, monkeypatch):
    """N resembling documents below the threshold make about N / GROUP groups of a band, not N; the links stay whole."""
    monkeypatch.setattr(jaccard, "GROUP", 50)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = base.copy()
        for at in rng.sample(range(200), 8):
            words[at] = f"own{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(600 + i, " ".join(f"z{i}_{k}" for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crowded = spark.sparkContext.broadcast(jaccard.crowded_buckets(docs, 3))
    name = ["n", "sum1", "sum2"]
    classes = jaccard._signatures(docs, 3, 90, crowded).groupBy(*name).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("mins").alias("mins")
    )
    members = jaccard.grouped(classes, 90).where("rep < 600").groupBy("g").agg(F.count("*").alias("members")).collect()
    sizes = sorted((r.members for r in members), reverse=True)
    print("members per group:", sizes)
    assert sum(sizes) == 600 and len(sizes) < 600 / 10
    found = jaccard.jaccard_components(docs, 3, 90).collect()
    label, links = jaccard_classes(rows, 3, 90)
    assert {r.doc_id: (r.component_id, r.n_links) for r in found} == {i: (label[i], links[i]) for i in label}


def test_words_of_a_known_kind_have_different_hashes():
    """Two words that a polynomial hash modulo 2^64 can't tell apart."""
    turn = [bin(i).count("1") % 2 for i in range(1024)]
    first, second = (bytes(97 + (x ^ flip) for x in turn) for flip in (0, 1))
    hashes, starts = jaccard._word_hashes(np.frombuffer(first + b" " + second + b" ab Ab ba", np.uint8))
    assert starts.tolist() == [0, 1025, 2050, 2053, 2056] and len(set(hashes.tolist())) == 4 and hashes[2] == hashes[3]


def test_texts_under_one_id_are_judged_each(spark):
    rows = [(1, "a b c d e f g"), (1, "totally different words in this text here"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a third text that nothing is like at all")]
    stay = jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    # Each id has a text that stays, so nothing that differs goes.
    assert sorted(map(tuple, stay)) == sorted({rows[0], rows[1], rows[3], rows[4]})


def test_exact_copies_by_hot_text_and_repeated_ids(spark):
    """A third of all rows equal, the rest unique, and ids that repeat: one row for each text, always the same."""
    rows = [(i, "hot  text" if i % 3 else "hot text", f"x{i}") for i in range(300)] + [(1000 + i, f"own text {i}", "y") for i in range(600)]
    rows += [(1000, "own text 0", "again"), (None, "own text 1", "z"), (None, "no id", "a"), (None, "no id", "b"), (5, None, "n"), (6, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(7)
    got = exact.deduplicated(docs).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows})
    kept = {(r.doc_id, r.text) for r in got}
    assert {(0, "hot text"), (1000, "own text 0"), (1001, "own text 1"), (5, None)} <= kept
    assert all(tuple(r) in set(rows) for r in got)
    assert sorted(map(tuple, exact.deduplicated(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
