"""Main text of HTML pages by wrapper induction.

Pages of a host whose leaves have the same tag paths, outside of articles, share a layout. The pages of a layout are
aligned with one of them (its smallest page_id) by simple tree matching: two nodes of the same
tag match, and among their children the best order-preserving matching is found by dynamic programming. A leaf of the
reference whose text recurs in its matches in most different pages of the layout is constant: template. The other
slots vary: content, unless they stand in a part of the page that is no article by its markup (menus, forms, adverts,
notices, comments and so on). Pages of layouts that have too few pages of their own are aligned with one reference for
the whole host, and for these a leaf must recur in most pages of the host.

Chrome is named by the markup: by tag and role, or by a class or id of which the whole token says so (`site-nav`,
`cookie-notice`, `related-posts`; not `has-sidebar`, `ad-hoc` or `share-title`). Paragraphs, headings and items inside an
article are never chrome by a class, nothing that holds an article or main element is, and neither is a form or a named
part that holds most of a page whose other text is next to nothing. Of several articles the one with most of their text
counts alone.

Lists of children are aligned in bounded memory: equal subtrees at both ends match, subtrees that occur once on both sides
anchor the rest, and what lies between anchors is aligned by dynamic programming with one byte for each cell, up to
`CELLS` cells; a larger stretch between two anchors is matched in order, kind by kind. So a page takes memory in proportion
to its size, and time but for `CELLS` cells for each stretch; what isn't matched is merely no template, no text is lost.

First pass: each page gets its layout and is stored with it. Second pass: each page is aligned and says which leaves
of the reference it repeats; copies of a page count once, so a group of equal pages can't turn its article into
template. Third pass: pages that have a template are aligned again and lose it. The join with the references is a
broadcast while all references together are proven to be small, else a shuffle that adaptive execution may split for a
large host.

Defined cases: NULL or empty html, and pages without any text, give an empty text, are no reference and don't count as
pages of their host; a NULL or unreadable url puts the page with the other pages
without a host; a NULL page_id is an ordinary row and is taken as reference last; hosts with fewer than `LEAST_PAGES`
different pages have no template; repeated rows get the same text; an empty table gives no rows; very long pages, pages of
very many siblings or levels and broken or endless tags are read in one pass; extra columns are ignored under any name.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.storage import materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: References up to this size in all are broadcast.
SMALL_BYTES = 64 << 20
#: Different pages of a layout or host from which a template is induced, and the share of them that must repeat a leaf.
LEAST_PAGES, SHARE = 5, 0.8
#: Cells of a table of child lists at most.
CELLS = 1 << 20
#: Stands for the whole host in the place of a layout.
ANY_LAYOUT = 0

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SILENT = set("script style title textarea noscript template iframe object svg canvas select button audio video".split())
#: Start tags that end an open element of one of these kinds.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
HOLDERS = set("table ul ol dl td th div section article body".split())

CHROME_TAGS = set("nav footer aside form menu dialog head".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alert menu".split())
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup login comment comments disqus respond related recommended share sharing social widget pagination pager toolbar".split()
)

#: Parts of a name before which a chrome word says what the element has, not what it is.
HAVING = set("has no with without is not".split())
#: Last parts of a name that make its first part say what the element is.
HOLDING = set(
    "area bar block box buttons button container content feed form group header holder icons inner items links list panel posts row "
    "section slot stories text unit wrap wrapper zone".split()
)
#: Elements of running text: inside an article no class makes them chrome.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())

START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARKS = re.compile(r"""[>"']""")


class Node:
    """A block-level element, or a run of text without a tag of its own (tag `#text`)."""

    __slots__ = ("tag", "chrome", "children", "text", "place", "template", "mark", "weight")

    def __init__(self, tag: str, chrome: bool = False):
        self.tag, self.chrome, self.children, self.text, self.place, self.template = tag, chrome, [], "", -1, False
        self.mark, self.weight = 0, 0.0


def _names_chrome(token: str) -> bool:
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())
    if not parts or parts[0] in HAVING:
        return False
    return parts[-1] in CHROME_WORDS or (parts[0] in CHROME_WORDS and parts[-1] in HOLDING)


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    names: list[str] = []
    for kind, *values in NAMING.findall(attributes):
        if kind.lower() == "role":
            if set("".join(values).lower().split()) & CHROME_ROLES:
                return True
        else:
            names += "".join(values).split()
    if tag == "article":
        return in_article and any("comment" in n.lower() for n in names)
    if tag in CHROME_TAGS or (tag == "header" and not in_article):
        return True
    return not (in_article and tag in TEXTUAL) and any(map(_names_chrome, names))


class _Tags:
    """Tags of a page one after the other, in one pass however broken they are."""

    def __init__(self, page: str):
        self.page, self.unquoted = page, set()

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, `/` of an end tag, name, attributes) of the first tag from `at` on; comments have no name."""
        found = START.search(self.page, at)
        if found is None:
            return None
        begin, inside = found.start(), found.end()
        if found[2] is None:
            comment = self.page.startswith("<!--", begin)
            end = self.page.find("-->" if comment else ">", inside)
            return begin, len(self.page) if end < 0 else end + (3 if comment else 1), "", "", ""
        end = self._end(inside)
        return begin, end, found[1], found[2].lower(), self.page[inside : end - 1]

    def _end(self, at: int) -> int:
        """Behind the tag's `>`, which isn't one between quotes, unless a quote is never closed; an open tag ends the page."""
        now = at
        while True:
            mark = _MARKS.search(self.page, now)
            if mark is None:
                return len(self.page) + 1
            if mark[0] == ">":
                return mark.end()
            closing = -1 if mark[0] in self.unquoted else self.page.find(mark[0], mark.end())
            if closing < 0:
                self.unquoted.add(mark[0])  # none is closed from here on
            now = mark.end() if closing < 0 else closing + 1


def parse(page: str) -> Node:
    """The tree of block-level elements; inline markup is dissolved into text runs."""
    root = Node("#root")
    stack: list[tuple[str, Node | None]] = [("#root", root)]
    holder, run = root, []
    open_tags: Counter[str] = Counter()
    tags = _Tags(page)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            leaf = Node("#text")
            leaf.text = text
            holder.children.append(leaf)

    def close(depth: int) -> None:
        nonlocal holder
        flush()
        while len(stack) > depth:
            open_tags[stack.pop()[0]] -= 1
        holder = next(node for _, node in reversed(stack) if node is not None)

    at = 0
    while at < len(page):
        found = tags.next(at)
        if found is None:
            run.append(page[at:])
            break
        begin, end, slash, tag, attributes = found
        run.append(page[at:begin])
        at = end
        if not tag or end > len(page):
            continue
        if slash:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                name, node = stack[depth]
                if name == tag:
                    if node is None:
                        open_tags[stack.pop(depth)[0]] -= 1
                    else:
                        close(depth)
                    break
                if node is not None and tag not in BLOCKS:
                    break  # an inline end tag doesn't reach out of its block
            continue
        if tag == "br":
            run.append(" ")
        if tag in VOID and tag not in BLOCKS:
            continue
        if tag in SILENT:
            silent = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = silent.end() if silent else len(page)
            continue
        chrome = _is_chrome(tag, attributes, open_tags["article"] + open_tags["main"] > 0)
        if tag not in BLOCKS and not chrome:
            stack.append((tag, None))
            open_tags[tag] += 1
            continue
        flush()
        closing = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for depth in range(len(stack) - 1, 0, -1) if any(open_tags[c] for c in closing) else ():
            name = stack[depth][0]
            if name in closing:
                close(depth)
                if tag not in ENDS:
                    break
            elif name in HOLDERS and name not in closing:
                break
        if tag in VOID:
            continue
        node = Node(tag, chrome)
        holder.children.append(node)
        stack.append((tag, node))
        open_tags[tag] += 1
        holder = node
    flush()
    _settle(root)
    return root


def _upwards(root: Node) -> list[Node]:
    """All nodes, each behind its children."""
    found, stack = [], [root]
    while stack:
        now = stack.pop()
        found.append(now)
        stack.extend(now.children)
    found.reverse()
    return found


def _unfold_holders(nodes: list[Node], root: Node) -> None:
    """What holds an article or main element is no chrome, nor is a named part that holds the text of a page without another."""
    size, plain, holds = {}, {}, set()
    for node in nodes:
        size[id(node)] = len(node.text) + sum(size[id(c)] for c in node.children)
        if (node.tag in ("article", "main") and not node.chrome) or any(id(c) in holds for c in node.children):
            holds.add(id(node))
            node.chrome = False
        plain[id(node)] = 0 if node.chrome else len(node.text) + sum(plain[id(c)] for c in node.children)
    whole = size[id(root)]
    if 10 * plain[id(root)] < whole:
        for node in nodes:
            if node.chrome and 2 * size[id(node)] > whole and (node.tag == "form" or node.tag not in CHROME_TAGS):
                node.chrome = False


def _settle(root: Node) -> None:
    """Fold single text runs and whole chrome parts into leaves, drop empty nodes, mark and weigh subtrees, number the leaves."""
    nodes = _upwards(root)
    _unfold_holders(nodes, root)
    for now in nodes:
        now.children = [c for c in now.children if c.children or c.text]
        if now.chrome:
            now.text, now.children = " ".join(c.text for c in now.children), []
        elif len(now.children) == 1 and now.children[0].tag == "#text":
            now.text, now.children = now.children[0].text, []
        now.mark = hash((now.tag, now.chrome, now.text, tuple([c.mark for c in now.children])))
        now.weight = 1.0 + sum([c.weight for c in now.children]) if now.children else 1.5
    for place, leaf in enumerate(leaves(root)):
        leaf.place = place


def leaves(node: Node) -> Iterator[Node]:
    """Leaves in page order."""
    stack = [node]
    while stack:
        now = stack.pop()
        if now.children:
            stack.extend(reversed(now.children))
        elif now.text:
            yield now


def _kind(node: Node) -> tuple[str, bool, bool]:
    return node.tag, node.chrome, bool(node.children)


def _stretches(left: list[Node], right: list[Node]) -> tuple[list[tuple[Node, Node]], list[tuple[list[Node], list[Node]]]]:
    """Equal subtrees that match for certain or by anchors, and the stretches between them."""
    low, m, n = 0, len(left), len(right)
    while low < min(m, n) and left[low].mark == right[low].mark:
        low += 1
    while m > low and n > low and left[m - 1].mark == right[n - 1].mark:
        m, n = m - 1, n - 1
    same = list(zip(left[:low], right[:low], strict=True)) + list(zip(left[m:], right[n:], strict=True))
    left, right = left[low:m], right[low:n]
    if len(left) * len(right) <= CELLS:
        return same, [(left, right)] if left and right else []
    # Anchors: the longest run, in the order of both sides, of subtrees that occur once on each.
    once = [{mark for mark, k in Counter(x.mark for x in side).items() if k == 1} for side in (left, right)]
    at = {y.mark: j for j, y in enumerate(right) if y.mark in once[0] & once[1]}
    ends: list[int] = []
    tails: list[tuple[int, int]] = []  # place on the left and on the right of the last anchor of each length
    back: dict[int, int | None] = {}
    for i, x in enumerate(left):
        j = at.get(x.mark)
        if j is None or x.mark not in once[0]:
            continue
        k = bisect_left(ends, j)
        back[i] = tails[k - 1][0] if k else None
        ends[k : k + 1], tails[k : k + 1] = [j], [(i, j)]
    anchors, now = [], tails[-1][0] if tails else None
    while now is not None:
        anchors.append((now, at[left[now].mark]))
        now = back[now]
    stretches, before = [], (-1, -1)
    for i, j in [*reversed(anchors), (len(left), len(right))]:
        part = left[before[0] + 1 : i], right[before[1] + 1 : j]
        if part[0] and part[1]:
            stretches.append(part)
        before = (i, j)
    return same + [(left[i], right[j]) for i, j in anchors], stretches


def _in_order(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
    """The first of each kind with the first of that kind, and so on, without crossings."""
    places: dict[tuple, deque[int]] = {}
    for j, y in enumerate(right):
        places.setdefault(_kind(y), deque()).append(j)
    pairs, last = [], -1
    for x in left:
        waiting = places.get(_kind(x), ())
        while waiting and waiting[0] <= last:
            waiting.popleft()
        if waiting:
            last = waiting.popleft()
            pairs.append((x, right[last]))
    return pairs


def _matched(left: list[Node], right: list[Node], score: Callable[[Node, Node], float]) -> tuple[float, list[tuple[Node, Node]]]:
    """The best order-preserving matching: its score and its pairs, with one byte for each cell."""
    n = len(right)
    above, turns = [0.0] * (n + 1), []
    for x in left:
        row, turn = [0.0], bytearray(n)
        for j, y in enumerate(right):
            best = above[j] + score(x, y)
            if above[j + 1] >= best:
                best = above[j + 1]
                turn[j] = 1
            if row[j] >= best:
                best = row[j]
                turn[j] = 2
            row.append(best)
        above = row
        turns.append(turn)
    pairs, i, j = [], len(left), n
    while i and j:
        turn = turns[i - 1][j - 1]
        if turn == 0:
            pairs.append((left[i - 1], right[j - 1]))
        i, j = i - (turn != 2), j - (turn != 1)
    return above[-1], pairs


def align(page: Node, reference: Node) -> list[tuple[Node, Node]]:
    """Leaves of the page with the leaves of the reference that simple tree matching gives them."""
    known: dict[tuple[int, int], tuple[float, list[tuple[Node, Node]]]] = {}
    cut: dict[tuple[int, int], tuple[list, list]] = {}

    def score(a: Node, b: Node) -> float:
        """Matched nodes; the same text counts a half more, so that equal texts are preferred."""
        if _kind(a) != _kind(b):
            return 0.0
        if a.mark == b.mark:
            return a.weight
        if not a.children:
            return 1.0
        return known[(id(a), id(b))][0]

    # Pairs below a pair are scored before it, on a stack of its own: pages may be nested deeper than Python can call.
    stack = [(page, reference, False)] if _kind(page) == _kind(reference) and page.children else []
    while stack:
        a, b, ready = stack.pop()
        if (id(a), id(b)) in known:
            continue
        if not ready:
            if a.mark == b.mark:
                continue  # every node matches its like
            cut[(id(a), id(b))] = _stretches(a.children, b.children)
            stack.append((a, b, True))
            for left, right in cut[(id(a), id(b))][1]:
                if len(left) * len(right) <= CELLS:
                    stack.extend((x, y, False) for x in left if x.children for y in right if _kind(x) == _kind(y))
                else:
                    stack.extend((x, y, False) for x, y in _in_order(left, right) if x.children)
            continue
        same, stretches = cut.pop((id(a), id(b)))
        total, pairs = 1.0 + sum(score(x, y) for x, y in same), same
        for left, right in stretches:
            if len(left) * len(right) <= CELLS:
                more, found = _matched(left, right, score)
            else:
                found = _in_order(left, right)
                more = sum(score(x, y) for x, y in found)
            total, pairs = total + more, pairs + found
        known[(id(a), id(b))] = (total, pairs)

    found: list[tuple[Node, Node]] = []
    todo = [(page, reference)] if _kind(page) == _kind(reference) else []
    while todo:
        a, b = todo.pop()
        if a.children:
            todo.extend(zip(a.children, b.children, strict=True) if a.mark == b.mark else known[(id(a), id(b))][1])
        else:
            found.append((a, b))
    return found


def content(page: Node) -> str:
    """Texts of the leaves that are content, in page order."""
    roots, stack = [], [page]
    while stack:
        now = stack.pop()
        if now.chrome:
            continue
        if now.tag in ("article", "main"):
            roots.append(now)
        else:
            stack.extend(reversed(now.children))
    if len(roots) > 1:
        sizes = [sum(len(leaf.text) for leaf in leaves(root)) for root in roots]
        if 2 * max(sizes) > sum(sizes):
            roots = [roots[sizes.index(max(sizes))]]
    kept = []
    for root in roots or [page]:
        kept += [leaf.text for leaf in leaves(root) if not leaf.chrome and not leaf.template]
    return "\n".join(kept)


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def layout_of(page: Node) -> int | None:
    """A number for the set of tag paths of the page's leaves; articles are not looked into. None without leaves."""
    paths, stack = set(), [(page, 0)]
    while stack:
        now, above = stack.pop()
        path = (above * 1_000_003 + zlib.crc32(f"{now.tag} {now.chrome}".encode())) % (2**61 - 1)
        if now.children and now.tag not in ("article", "main"):
            stack.extend((c, path) for c in now.children)
        elif now.children or now.text:
            paths.add(path)
    if not paths:
        return None
    named = hashlib.blake2b(",".join(map(str, sorted(paths))).encode(), digest_size=8).digest()
    return int.from_bytes(named, "big", signed=True) or 1


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        layouts = [layout_of(parse(page.as_py() or "")) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.int64())], [*batch.schema.names, "layout"])


def _references(pages: DataFrame, least_pages: int) -> DataFrame:
    """host, layout and html of the page that others are aligned with, for layouts of enough different pages.

    The layout is `ANY_LAYOUT` for hosts of enough pages that have other layouts too.
    """
    some = pages.where("layout IS NOT NULL")
    sizes = some.select("host", "layout", F.xxhash64("html").alias("copy")).distinct().groupBy("host", "layout").agg(F.count("*").alias("n"))
    sizes = materialise(sizes, "wrapper-layouts")
    hosts = sizes.groupBy("host").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    hosts = hosts.where((F.col("n") >= least_pages) & (F.col("least") < least_pages))
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.xxhash64("html").alias("h"))
    of_layout = some.join(sizes.where(F.col("n") >= least_pages), ["host", "layout"], "left_semi")
    of_host = some.join(hosts, "host", "left_semi").withColumn("layout", F.lit(ANY_LAYOUT).cast("long"))
    return of_layout.unionByName(of_host).groupBy("host", "layout").agg(F.min_by("html", first).alias("reference"))


def _tree(reference: str, trees: dict[str, Node]) -> Node:
    if reference not in trees:
        if len(trees) > 2000:
            trees.clear()
        trees[reference] = parse(reference)
    return trees[reference]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[str, Node] = {}
    for batch in batches:
        same = []
        for page, reference in zip(batch.column("html"), batch.column("reference"), strict=True):
            pairs = align(parse(page.as_py() or ""), _tree(reference.as_py(), trees))
            same.append([b.place for a, b in pairs if a.text == b.text])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("host", "layout", "copy")], pa.array(same, pa.list_(pa.int32()))], ["host", "layout", "copy", "same"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[str, Node] = {}
    for batch in batches:
        texts = []
        for page, reference, template in zip(*(batch.column(c) for c in ("html", "reference", "template")), strict=True):
            tree, constant = parse(page.as_py() or ""), set(template.as_py() or ())
            if constant:
                for a, b in align(tree, _tree(reference.as_py(), trees)):
                    a.template = b.place in constant and a.text == b.text
            texts.append(content(tree))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def main_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"))
    pages = pages.mapInArrow(_laid_out, "page_id long, url string, html string, host string, layout long")
    pages = materialise(pages, "wrapper-pages")
    references = materialise(_references(pages, least_pages), "wrapper-references")
    small = (references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= SMALL_BYTES
    near = F.broadcast if small else lambda x: x

    some = pages.where("layout IS NOT NULL").select("host", "layout", F.xxhash64("html").alias("copy"), "html")
    whole = references.where(F.col("layout") == ANY_LAYOUT)
    joined = some.join(near(references), ["host", "layout"]).unionByName(some.drop("layout").join(near(whole), "host"))
    repeated = joined.mapInArrow(_repeated, "host string, layout long, copy long, same array<int>")
    different = repeated.groupBy("host", "layout", "copy").agg(F.first("same").alias("same"))
    counted = different.select("host", "layout", F.explode(F.array_append("same", -1)).alias("place"))
    counted = counted.groupBy("host", "layout", "place").agg(F.count("*").alias("n"))
    of_layout = Window.partitionBy("host", "layout")
    constant = counted.withColumn("pages", F.max(F.when(F.col("place") == -1, F.col("n"))).over(of_layout)).where(
        (F.col("place") >= 0) & (F.col("pages") >= least_pages) & (F.col("n") >= share * F.col("pages"))
    )
    templates = constant.groupBy("host", "layout").agg(F.collect_list("place").alias("template"))
    wrappers = references.join(templates, ["host", "layout"], "left").withColumn("wrapper", F.struct("reference", "template")).drop("reference", "template")
    wrappers = materialise(wrappers, "wrappers")
    of_host = wrappers.where(F.col("layout") == ANY_LAYOUT).select("host", F.col("wrapper").alias("of_host"))
    return (
        pages.join(near(wrappers), ["host", "layout"], "left")
        .join(near(of_host), "host", "left")
        .select("page_id", "url", "html", F.coalesce("wrapper", "of_host").alias("wrapper"))
        .select("page_id", "url", "html", "wrapper.reference", "wrapper.template")
        .mapInArrow(_extracted, "page_id long, url string, text string")
    )
