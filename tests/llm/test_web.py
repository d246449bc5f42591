"""Archives and page texts: magic inside payloads, many splits, odd markup."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quantloom.llm import warc, wrapper
from quantloom.storage import new_path

PAGES = "page_id long, url string, html string"


def _sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def _read(spark, path):
    rows = warc.read_archives(spark, path).select(
        warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"))
    )
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize(("compression", "split"), [("gzip", "128m"), ("none", "4k")])
def test_archive_round_trip(spark, compression, split):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n broken WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<p>{'page ' * (i % 50)}{i}</p>") for i in range(200)]
    rows += [(300 + i, "u\r\nFake: y", fake + "é" * i) for i in range(8)] + [(400, None, fake), (299, "z", fake + "éé")]
    rows += [(500, "a", None), (501, "b", ""), (None, "c", "null id"), (502, "same", "WARC/1.1\r\n"), (502, "same", "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, PAGES)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        again = h and i is not None and first[h] != i or (not h and i != first[""])
        want.append((i, len((h or "").encode()), _sha1(h), "revisit" if again else "response", first[h or ""] if again else None))
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path, compression=compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert _read(spark, path) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_archive(spark):
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert _read(spark, path) == []


def test_reachable_follows_the_chain_only(spark):
    rows = [("f", 10, 50), ("f", 20, 30), ("f", 30, 99), ("f", 50, 80), ("f", 60, 80), ("f", 80, 120), ("g", 10, 20), ("g", 15, 20), ("g", 20, 40)]
    found = warc.reachable(spark.createDataFrame(rows, "file string, start long, next long"))
    assert sorted((r.file, r.start) for r in found.collect()) == [("f", 10), ("f", 50), ("f", 80), ("g", 10), ("g", 20)]


def test_markup():
    page = (
        '<body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">take</div><article><header><h1>T &amp; x</h1>'
        '</header><p>a<b>b</b> c<br>d<p>e<ul><li>x<li>y <p>z</ul><div>t<div>u</div>v</div><section class="comments"><p>bad</section>'
        '<script>var a="</p>"</script><form>f<input></form></article><aside>s</aside><footer>f</footer>'
    )
    assert wrapper.content(wrapper.parse(page)) == "T & x\nab c d\ne\nx\ny\nz\nt\nu\nv"
    assert wrapper.content(wrapper.parse("a &lt; b < c <!-- d --> <p unfinished")) == "a < b < c"
    assert wrapper.content(wrapper.parse("<div>" * 3000 + "deep")) == "deep"


def test_template_is_what_recurs(spark):
    body = '<html><body><div><p>Read more on our site</p><p>own text {i} of page</p><p>All rights belong to us</p></div></body></html>'
    rows = [(i, "http://a.org/x", body.format(i=i)) for i in range(12)] + [(100, "http://b.org/", body.format(i=1))]
    rows += [(200 + i, "http://c.org/", body.format(i=7)) for i in range(30)] + [(900, None, None), (None, "::", "<p>x</p>")]
    rows += [rows[0]]
    found = wrapper.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == f"own text {i} of page" for i in range(12))
    # A single page and thirty copies of one page are no evidence of a template.
    assert texts[100].count("\n") == texts[200].count("\n") == 2
    assert texts[900] == "" and texts[None] == "x"
    assert wrapper.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_shuffled_references_give_the_same_texts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/", f"<p>same</p><p>own {i}</p>") for i in range(30)]
    pages = spark.createDataFrame(rows, PAGES)
    broadcast = sorted(map(tuple, wrapper.main_texts(pages).collect()))
    monkeypatch.setattr(wrapper, "SMALL_BYTES", 0)
    assert sorted(map(tuple, wrapper.main_texts(pages).collect())) == broadcast


def test_deeply_nested_references(spark):
    rows = [(i, "http://deep.org/", "<div>" * 3000 + f"<p>same</p><p>own {i}</p>") for i in range(6)]
    texts = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {i: f"own {i}" for i in range(6)}


LAYOUTS = {
    "one": "<html><body><div><p>Read more here</p><p>own one {i}</p><p>All rights reserved</p></div></body></html>",
    "two": "<html><body><section><ul><li>Old menu</li><li>own two {i}</li></ul><table><tr><td>Foot</td></tr></table></section></body></html>",
}


def test_two_layouts_of_a_host(spark):
    rows = [(i, "http://a.org/x", LAYOUTS["one" if i % 5 < 3 else "two"].format(i=i)) for i in range(50)]
    texts = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {i: f"own {'one' if i % 5 < 3 else 'two'} {i}" for i in range(50)}


@pytest.mark.parametrize("broken", [None, "", "<script>x</script>", "<h1>Not found</h1>"])
def test_first_page_without_the_layout(spark, broken):
    rows = [(i, "http://a.org/x", LAYOUTS["one"].format(i=i)) for i in range(1, 13)] + [(0, "http://a.org/y", broken)]
    texts = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {i: f"own one {i}" for i in range(1, 13)} | {0: "Not found" if broken and "h1" in broken else ""}


def test_pages_of_rare_layouts_use_the_host(spark, monkeypatch):
    rows = [(i, "http://a.org/x", LAYOUTS["one"].format(i=i).replace("</div>", f"<h{1 + i % 4}>Extra {i}</h{1 + i % 4}></div>")) for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    texts = {r.page_id: r.text for r in wrapper.main_texts(pages).collect()}
    assert texts == {i: f"own one {i}\nExtra {i}" for i in range(12)}
    monkeypatch.setattr(wrapper, "SMALL_BYTES", 0)
    assert {r.page_id: r.text for r in wrapper.main_texts(pages).collect()} == texts


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div id="page" class="hfeed no-sidebar"><main><p>a</p></main></div>', "a"),
        ('<form id="aspnetForm"><div><article><p>a</p></article></div></form>', "a"),
        ('<form id="aspnetForm"><p>the whole page in one form, as it is</p><input></form><nav>x</nav>', "the whole page in one form, as it is"),
        ('<article><p class="first alert">a</p><h2 class="share-title">b</h2><div class="ad-hoc">c</div><p class="related-work">d</p></article>', "a\nb\nc\nd"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>", "if x=2 then"),
        ('<article><p>t</p></article><article><p>the story itself is the long one</p></article><article><p>u</p></article>', "the story itself is the long one"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ('<div class="cookie-notice">x</div><div class="siteHeader nav-bar">y</div><div id="related-posts">z</div><div><p>kept</p></div>', "kept"),
        ('<article><p>a</p><div class="comment-list"><p>bad</p></div><article class="comment">bad</article></article>', "a"),
        ('<article><div role="complementary">x</div><p title="a > b">q</p></article>', "q"),
        ('<p>a <b title="never closed>b</b> c</p>', "a b c"),
    ],
)
def test_common_layouts(page, text):
    assert wrapper.content(wrapper.parse(page)) == text


def test_alignment_of_lists_equals_the_full_table():
    """The best matching by a full table, against trimmed ends, anchors and one byte for each cell."""
    rng = random.Random(4)
    for _ in range(60):
        sides = []
        for _ in range(2):
            tags = [rng.choice(["p", "h2", "li"]) for _ in range(rng.randint(0, 9))]
            sides.append("".join(f"<{t}>{rng.choice('abc')}</{t}>" for t in tags) + "<p>end</p>")
        a, b = (wrapper.parse(f"<div>{side}<table><tr><td>x</td></tr></table></div>") for side in sides)
        pairs = wrapper.align(a, b)
        x, y = list(wrapper.leaves(a)), list(wrapper.leaves(b))
        best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                s = (1.5 if p.text == q.text else 1.0) if p.tag == q.tag else 0.0
                best[i + 1][j + 1] = max(best[i][j] + s, best[i][j + 1], best[i + 1][j])
        assert sum(1.5 if p.text == q.text else 1.0 for p, q in pairs) == best[-1][-1]
        order = sorted((p.place, q.place) for p, q in pairs)
        assert all(q1 < q2 for (_, q1), (_, q2) in zip(order, order[1:]))


def test_very_many_siblings_and_broken_tags_take_seconds_and_little_memory():
    pages = [
        wrapper.parse("<div><p>menu</p>" + "".join(f"<div><p>{word} {i}</p></div>" if i % 7 else f"<p>ad {i % 3}</p>" for i in range(20_000)) + "<p>foot</p></div>")
        for word in ("own", "other")
    ]
    tracemalloc.start()
    begin = time.perf_counter()
    pairs = wrapper.align(*pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {"menu", "foot"} <= {a.text for a, b in pairs if a.text == b.text}
    assert time.perf_counter() - begin < 30 and peak < 200 << 20
    for broken in ("<a" * 500_000, "<a <" * 250_000, '<a "' * 250_000 + ">", "<a '>" * 200_000, "<b>" * 300_000 + "</i>" * 100_000, "<!--" * 200_000, "<p>x" * 100_000):
        begin = time.perf_counter()
        wrapper.content(wrapper.parse("<p>kept</p>" + broken))
        assert time.perf_counter() - begin < 20, broken[:10]


def test_templates_decide_where_the_markup_tells_nothing(spark):
    """Pages without articles and telling names: what recurs goes, and with induction switched off it stays."""
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        story = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 5))]
        extra = "<div><p>Members get more</p></div>" if i % 2 else ""
        body = "".join(f"<p>{s}</p>" for s in story)
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<div><ul><li>Home</li><li>About us</li></ul></div><div>{extra}{body}</div><div><p>Imprint of h{i % 2}</p></div>"))
        want[i] = "\n".join(story)
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("x"), "layout": F.lit(1), "text": F.lit("y")})
    assert {r.page_id: r.text for r in wrapper.main_texts(pages).collect()} == want
    off = {r.page_id: r.text for r in wrapper.main_texts(pages, least_pages=10**9).collect()}
    assert all("Home" in off[i] and "Imprint" in off[i] for i in want)
