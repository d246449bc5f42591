"""Importance resampling, Merkle manifest and decontamination against plain Python, odd cases included."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_corpus import SMALL_LETTERS
from pyspark.sql import functions as F

from quantloom.llm import decontamination, merkle, resampling
from quantloom.llm.plainwords import pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string"


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(SMALL_LETTERS))


@pytest.fixture(scope="module")
def target(spark):
    rows = [(1, "The QUICK brown fox jumps over the lazy dog while nobody looks"), (2, None), (3, ""), (4, "Ünï çödé 中文"), (None, "a b c a b c a b c a b c"), (5, "one two"), (5, "two one")]
    return spark.createDataFrame(rows, BENCH)


# --- importance resampling ----------------------------------------------------------------------


def _features(text: str | None, longest: int) -> list[int]:
    words = _words(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _brute_ranks(docs, target, buckets, longest, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(f % buckets for f in _features(text, longest))
    for text in target:
        t.update(f % buckets for f in _features(text, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = _features(text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % buckets] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_words(text))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able, 1):
        row.append(place if place <= percent * len(able) // 100 else None)
    return Counter((*r[:4], r[5] if len(r) > 5 else None) for r in rows)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least", "segment_rows"), [(1, 10_000, 10, 20, 1 << 16), (2, 50, 50, 0, 3), (3, 7, 100, 1, 1)])
def test_ranks_equal_brute_force(odd, target, longest, buckets, percent, least, segment_rows):
    got = resampling.ranked(odd, target, percent, least, buckets, longest, segment_rows=segment_rows).collect()
    want = _brute_ranks([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], buckets, longest, percent, least)
    assert Counter(map(tuple, got)) == want


def test_ties_and_one_hot_score_are_split(spark, none, target):
    """All rows have the same weight; the noise of an id is shared by a third of the rows."""
    rows = [(i if i % 3 else 0, "same words here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = resampling.ranked(docs, target, 40, 1, segment_rows=100)
    assert got.count() == 3000
    ranks = sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 1201))
    ordered = [(-r.score, r.doc_id) for r in got.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert ordered == sorted(ordered)
    assert resampling.ranked(none, target).count() == 0


def test_samples_stay_bounded_and_segments_even(spark):
    scores = spark.range(0, 50_000, 1, 9).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 1000).alias("score"))
    splitters = resampling.regular_splitters(scores, 50_000, 20, samples=2_000)
    assert len(splitters) == 19
    sizes = [r["count"] for r in resampling.in_segments(scores, splitters).groupBy("segment").count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 50_000 and max(sizes) < 2 * 50_000 / 20


def test_resampled_keeps_columns(odd, target):
    got = resampling.resampled(odd, target, percent=50)
    assert got.columns == odd.columns and 0 < got.count() < odd.count()


# --- Merkle manifest ----------------------------------------------------------------------------


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values) -> str:
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(hashes: list[str], fan: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf the siblings on its left and right at each level."""
    paths = [[] for _ in hashes]
    at = list(range(len(hashes)))
    level = hashes
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i - i % fan : i - i % fan + fan]
            paths[leaf].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        at = [i // fan for i in at]
        level = [_h("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def _brute_manifest(rows: list[dict], fan: int, tampered) -> Counter:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    leaf = lambda r, text: _leaf([r["doc_id"], r["source"], r["lang"], r["n_chars"], text])
    done = []
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        done.append(_tree([leaf(r, r["text"]) for r in trees[name]], fan))
    root, over = _tree([d[0] for d in done], fan)
    out = []
    for name, (subroot, paths), above in zip(names, done, over, strict=True):
        for r, path in zip(trees[name], paths, strict=True):
            text = r["text"].translate(SMALL_LETTERS) if r["text"] is not None and tampered(r) else r["text"]
            folded = leaf(r, text)
            for left, right in path + above:
                folded = _h(left + folded + right)
            proof = "".join(left + right for left, right in path + above)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_manifest_equals_brute_force(spark, odd, none, fan):
    rng = random.Random(fan)
    more = [(i, f"Text {i} ÄÖ", rng.choice(["en", "en", "en", "fr", None]), "s", i, 1, "b", None, None) for i in range(100, 300)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    is_tampered = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = merkle.manifest(docs, is_tampered, merkle.lower_ascii(F.col("text")), fan_out=fan).collect()
    want = _brute_manifest([r.asDict() for r in docs.collect()], fan, lambda r: (r["doc_id"] or 1) % 3 == 0)
    assert Counter(map(tuple, got)) == want
    assert {r.verified for r in got} == {True, False}
    assert merkle.manifest(none).count() == 0


def test_manifest_of_one_row_and_of_one_tree(spark):
    one = spark.createDataFrame([(1, "T", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == "" and row.verified


# --- decontamination ----------------------------------------------------------------------------


def _brute_hits(docs: list[tuple], items: list[tuple], width: int) -> Counter:
    windows: dict = {}
    for name, text in items:
        words = _words(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[at : at + width]), set()).add("null" if name is None else str(name))
    out = []
    for i, text in docs:
        words, hit, names = _words(text), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                owners = windows.get(tuple(words[at : at + n]))
                if owners:
                    names |= owners
                    hit |= set(range(at, at + n))
        out.append((i, len(words), len(hit), tuple(sorted(names))))
    return Counter(out)


def _hits(found) -> Counter:
    for r in found:
        assert r.n_items == len(r["items"]) and r.n_hit == sum(s.stop - s.start for s in r.spans)
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found)


@pytest.mark.parametrize(("width", "shard", "block"), [(10, 1 << 20, 1 << 20), (3, 50, 1 << 20), (4, 1 << 20, 5), (1, 7, 5)])
def test_hits_equal_brute_force(spark, odd, none, target, monkeypatch, width, shard, block):
    monkeypatch.setattr(decontamination, "ROWS", 2)
    monkeypatch.setattr("quantloom.llm.plainwords.PIECE", 40)
    rng = random.Random(width)
    draw = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    few = [f"w{i}" for i in range(4)]
    docs = odd.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, draw(rng.choice([0, 2, 30, 300]), [*few, "x"])) for i in range(20)], "doc_id long, text string")
    )
    items = target.unionByName(spark.createDataFrame([(50 + i, draw(rng.choice([1, 3, width, 3 * width]), few)) for i in range(8)], BENCH))
    found = decontamination.contamination(docs, items, width, shard, block).collect()
    assert _hits(found) == _brute_hits([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], width)
    assert decontamination.contamination(none, items).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(docs, items.limit(0)).collect())


def test_passage_in_every_document_and_across_pieces(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} " * 5 + (passage if i % 3 else passage.upper()) + f" z{i}" * (i % 7)) for i in range(600)]
    long = " ".join(f"k{i}" for i in range(300_000))
    rows += [(1000, long + " " + passage + " " + long), (1001, (passage + " ") * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, "p3 p4"), (9, "nowhere to be found at all in any of these texts here")], BENCH)
    found = {r.doc_id: r for r in decontamination.contamination(docs, items, shard_words=5_000).collect()}
    assert all(found[i].n_hit == 40 and found[i]["items"] == ["7", "8"] for i in range(600))
    assert found[1000].spans[0].start == 300_000 and found[1000].n_hit == 40
    assert found[1001].n_hit == 80_000 and len(found[1001].spans) == 1


def test_decontaminated_texts(spark, odd, target):
    got = decontamination.decontaminated(odd, target, width=5)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[4] == "one"
    assert texts[5] == "" and "quick" not in texts[8] and "house" in texts[8]
    assert decontamination.without_words("Ab, cd! (Ef) gh.", [(1, 3)]) == "Ab, ) gh."


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(3)
    for n_symbols in (2, 3, 70_000):
        parts = [np.r_[rng.integers(1, n_symbols, rng.integers(1, 30)), 0] for _ in range(40)]
        text = np.concatenate([*parts, parts[0], parts[0]])
        order = decontamination.suffix_order(text, 40)
        unique = [(0, i) if x == 0 else (1, int(x)) for i, x in enumerate(text)]
        assert sorted(range(len(text)), key=lambda i: unique[i : i + 31]) == order.tolist()
        matrix = decontamination.WaveletMatrix(text, n_symbols)
        symbol, _ = matrix.followed(np.arange(len(text)))
        assert (symbol == text).all()


def test_pieces_never_split_words():
    text = ("Wort-äö " * 50 + "x" * 300 + " End").encode()
    assert b"".join(p for _, p in pieces(text, 16)) == text.lower()
    assert [w for _, p in pieces(text, 16) for w in WORD.findall(p.decode())] == WORD.findall(text.lower().decode())
