"""Benchmark decontamination with an FM-index for each shard of the documents.

A benchmark item becomes windows of `width` consecutive words (an item of fewer words is one window). Words are compared
as they are spelt: those of the benchmark are numbered, every other word of a document cuts its text, for no window
holds it.

1. A task reads documents until it has a shard of about `SHARD` words. Stretches of numbered words that are shorter than
   the shortest window are left out, the others are cut into segments of `SEGMENT` words plus the overlap that a window
   needs, each closed by an end mark, so sorting the suffixes takes a fixed number of doubling rounds, however often and
   long texts repeat.
2. The shard's Burrows-Wheeler transform is kept as a wavelet matrix (one bit vector for each bit of a word's number, with
   counts for every 64 bits) beside every `SAMPLED`-th suffix position.
3. All windows are searched backwards at once: a range of suffixes for each window, narrowed word by word by two ranks.
4. Places of the ranges are walked back to the next sampled suffix, which gives their position; positions become spans of
   words, overlapping or touching spans are merged.

Documents are read once and never shuffled. The benchmark travels in blocks of at most `BLOCK_WORDS` words, each a pass
over the documents; the passes of a larger benchmark are put together by document. A task holds one shard, whatever the
length or number of its documents; every repeat of a passage is found, and no list is cut.

Defined cases: a NULL, empty or wordless text has no words and no hits; an item without words has no window; windows
that several items share count for each of them; a NULL item_id goes by the name `null`, items that repeat an id count once; rows that
repeat an id are judged one by one; very long texts are read piece by piece and may span several shards; an empty
benchmark contaminates nothing, an empty table gives no rows; extra columns are ignored here, `decontaminated` keeps them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.plainwords import WORD, pieces, texts_of, words
from quantloom.llm.text import packed
from quantloom.operators.order import row_positions
from quantloom.storage import materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 10
#: Words of a shard, of a segment without its overlap, and of a block of the benchmark, each at most about so many.
SHARD, SEGMENT, BLOCK_WORDS = 1 << 20, 54, 1 << 20
#: One suffix position in so many is kept.
SAMPLED = 8

SPANS = "array<struct<start:long,stop:long>>"
_FOUND = f"doc_id long, text_key string, n_words long, n_hit long, n_items long, items array<string>, spans {SPANS}"


# --- index --------------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in an array, by one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.size, self.bits = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.blocks, self.before, self.zeros = [], [], []
        now = symbols
        for b in reversed(range(self.bits)):
            ones = (now >> b) & 1 == 1
            padded = np.zeros((self.size // 64 + 1) * 64, bool)
            padded[: self.size] = ones
            block = np.packbits(padded, bitorder="little").view("<u8")
            self.blocks.append(block)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(block), dtype=np.int64)[:-1]])
            self.zeros.append(self.size - int(ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the level before these places."""
        block = at >> 6
        inside = self.blocks[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][block] + np.bitwise_count(inside)

    def mapped(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the places lie after the last level, following the symbol: its rank plus its first place there."""
        for level in range(self.bits):
            ones = self._ones(level, at)
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def followed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and where the places lie after the last level."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self._ones(level, at)
            one = (self.blocks[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return symbol, at


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order; each 0 is an end mark of its own, below all symbols, and none is more than `longest` away.

    Prefix doubling; suffixes whose place is settled are left out of the following rounds.
    """
    n = len(text)
    order = np.argsort(text.astype(np.uint16) if text.max() < 1 << 16 else text, kind="stable")
    symbols = text[order]
    first = np.r_[True, symbols[1:] != symbols[:-1]] | (symbols == 0)
    rank = np.empty(n + longest + 1, np.int64)
    rank[n:] = -1
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    span = 1
    open_at = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places that share their rank
    while len(open_at) and span < longest:
        suffix = order[open_at]
        key = rank[suffix] * (n + 2) + rank[suffix + span] + 1
        turn = np.argsort(key)
        suffix, key = suffix[turn], key[turn]
        order[open_at] = suffix
        new = np.r_[True, key[1:] != key[:-1]]
        rank[suffix] = open_at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_at = open_at[~(new & np.r_[new[1:], True])]
        span *= 2
    return order


class FmIndex:
    """Backward search and location in one shard.

    `text` holds symbols of 1 and above, each segment closed by an end mark (0). No search passes through a mark.
    """

    def __init__(self, text: np.ndarray, longest: int, n_symbols: int):
        order, ends = suffix_order(text, longest), np.flatnonzero(text == 0)
        self.text_size = len(text)
        before = text[order - 1]  # the first suffix of all is preceded by the last mark
        self.matrix = WaveletMatrix(before, n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        self.starts = np.r_[0, np.cumsum(counts)]  # first suffix of each symbol
        symbols = np.arange(n_symbols)
        self.shift = self.starts[:-1] - self.matrix.mapped(np.zeros(n_symbols, np.int64), symbols)
        # Every SAMPLED-th position and the first of each segment, so that no walk meets a mark.
        sampled = np.zeros(len(text), bool)
        sampled[::SAMPLED] = True
        sampled[0] = True
        sampled[(ends + 1)[:-1]] = True
        marked = sampled[order]
        self.is_marked, self.marked_before = marked, np.cumsum(marked) - marked
        self.positions = order[marked]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-the-last suffix that begins with each phrase; phrases are right-aligned, 0 on their left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_size, np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            going = alive[lengths[alive] > step]
            symbol = phrases[going, phrases.shape[1] - 1 - step]
            low[going] = self.matrix.mapped(low[going], symbol) + self.shift[symbol]
            high[going] = self.matrix.mapped(high[going], symbol) + self.shift[symbol]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places."""
        out, steps = np.empty(len(rows), np.int64), 0
        where, now = np.arange(len(rows)), rows
        while len(now):
            hit = self.is_marked[now]
            out[where[hit]] = self.positions[self.marked_before[now[hit]]] + steps
            where, now = where[~hit], now[~hit]
            if len(now):
                symbol, at = self.matrix.followed(now)
                now, steps = at + self.shift[symbol], steps + 1
        return out


# --- phrases ------------------------------------------------------------------------------------


@dataclass
class Phrases:
    """Distinct windows of a block of the benchmark, as numbers of its words, and the items of each."""

    numbers: dict[bytes, int]
    rows: np.ndarray  # right-aligned, 0 on the left
    lengths: np.ndarray
    item_starts: np.ndarray  # items of window w: items[item_starts[w]:item_starts[w + 1]]
    items: np.ndarray
    names: list[str]


def phrases_of(items: list[tuple[str, bytes]], width: int) -> Phrases:
    numbers: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], list[int]] = {}
    names: list[str] = []
    for name, text in items:
        line = [numbers.setdefault(w, len(numbers) + 1) for part in words(text) for w in part]
        if not line:
            continue
        for at in range(max(1, len(line) - width + 1)):
            owners = windows.setdefault(tuple(line[at : at + width]), [])
            if not owners or owners[-1] != len(names):
                owners.append(len(names))
        names.append(name)
    rows = np.zeros((len(windows), width), np.int64)
    for i, window in enumerate(windows):
        rows[i, width - len(window) :] = window
    lengths = np.array([len(w) for w in windows], np.int64)
    counts = [len(o) for o in windows.values()]
    owners = np.array([x for o in windows.values() for x in o], np.int64)
    return Phrases(numbers, rows, lengths, np.r_[0, np.cumsum(counts, dtype=np.int64)], owners, names)


#: Rows of the benchmark that are never parted.
ROWS = 256


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items (item, text) in blocks of at most about `block_words` words (or `ROWS` items), in the order of their names."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    placed = row_positions(named.where("text IS NOT NULL"), ["item", "text"], "place").withColumn("part", F.floor(F.col("place") / ROWS))
    sizes = placed.groupBy("part").agg(F.sum(F.octet_length("text") / 2 + 1).alias("words")).orderBy("part")
    bounds, total = [0], 0.0
    for part in sizes.toLocalIterator():
        if total and total + part.words > block_words:
            bounds.append(part.part)
            total = 0.0
        total += part.words
    limits = zip(bounds, [*bounds[1:], None], strict=True)
    return [placed.where((F.col("part") >= low) & (F.lit(True) if high is None else F.col("part") < high)) for low, high in limits]


# --- search -------------------------------------------------------------------------------------


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one; `starts` is sorted."""
    reach = np.maximum.accumulate(stops)
    new = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return starts[new], reach[last]


class Shard:
    """Stretches of numbered words of consecutive documents, and what the search finds in them."""

    def __init__(self, phrases: Phrases, width: int):
        self.phrases, self.width = phrases, width
        self.least = int(phrases.lengths.min()) if len(phrases.lengths) else 1
        self.parts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # place of each symbol: document << 40 | word
        self.size = 0

    def add(self, document: int, first: int, line: np.ndarray) -> None:
        """Words `first` and following of a document."""
        known = np.r_[False, line > 0, False]
        turns = np.flatnonzero(known[1:] != known[:-1])
        begins, ends = turns[::2], turns[1::2]
        long = ends - begins >= self.least
        if not long.any():
            return
        begins, ends = begins[long], ends[long]
        # Segments: SEGMENT words and the overlap, up to the stretch's end.
        overlap = self.width - 1
        pieces_of = np.maximum(1, -(-(ends - begins - overlap) // SEGMENT))
        at = np.repeat(begins, pieces_of) + SEGMENT * (np.arange(pieces_of.sum()) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of))
        sizes = np.minimum(at + SEGMENT + overlap, np.repeat(ends, pieces_of)) - at
        index = np.repeat(at - np.r_[0, np.cumsum(sizes + 1)[:-1]], sizes + 1) + np.arange((sizes + 1).sum())
        closing = np.cumsum(sizes + 1) - 1
        symbols = np.r_[line, 0][index]
        symbols[closing] = 0
        self.parts.append(symbols)
        self.places.append((document << 40) + first + index)
        self.size += len(symbols)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, document and first word of every occurrence; what the shard held is forgotten."""
        none = np.empty(0, np.int64)
        if not self.size or not len(self.phrases.lengths):
            self.parts, self.places, self.size = [], [], 0
            return none, none, none
        text, places = np.concatenate(self.parts), np.concatenate(self.places)
        self.parts, self.places, self.size = [], [], 0
        index = FmIndex(text, SEGMENT + self.width + 1, len(self.phrases.numbers) + 1)
        low, high = index.ranges(self.phrases.rows, self.phrases.lengths)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        rows = np.repeat(low[found] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        at = places[index.located(rows)]
        return np.repeat(found, counts), at >> 40, at & ((1 << 40) - 1)


@dataclass
class _Open:
    """A document whose shard is still being filled."""

    doc_id: int | None
    text_key: str | None
    n_words: int
    windows: list[np.ndarray]
    starts: list[np.ndarray]


def _finished(docs: list[_Open], phrases: Phrases) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for doc in docs:
        spans, items, n_hit = [], [], 0
        if doc.windows:
            window, start = np.concatenate(doc.windows), np.concatenate(doc.starts)
            order = np.argsort(start, kind="stable")
            begin, stop = _merged(start[order], (start + phrases.lengths[window])[order])
            n_hit = int((stop - begin).sum())
            spans = [{"start": int(b), "stop": int(e)} for b, e in zip(begin, stop, strict=True)]
            own = [phrases.items[phrases.item_starts[w] : phrases.item_starts[w + 1]] for w in np.unique(window)]
            items = sorted({phrases.names[i] for i in np.unique(np.concatenate(own))})
        for column, value in zip(columns, (doc.doc_id, doc.text_key, doc.n_words, n_hit, len(items), items, spans), strict=True):
            column.append(value)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.string()), span]
    names = ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items", "spans"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pass(docs: DataFrame, phrases: Phrases, width: int, shard_words: int) -> DataFrame:
    """Every document (doc_id, text_key, text) against one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = known.numbers.get
        shard, open_docs = Shard(known, width), []

        def search() -> None:
            window, document, start = shard.search()
            order = np.argsort(document, kind="stable")
            cuts = np.flatnonzero(np.diff(document[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    doc = open_docs[document[rows[0]]]
                    doc.windows.append(window[rows])
                    doc.starts.append(start[rows])

        for batch in batches:
            ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_key"))
            for doc_id, key, text in zip(ids, keys, texts_of(batch), strict=True):
                doc = _Open(doc_id, key, 0, [], [])
                open_docs.append(doc)
                tail = np.empty(0, np.int64)  # a window may begin in the piece before
                for part in words(text):
                    line = np.r_[tail, np.fromiter(map(number, part, repeat(0)), np.int64, len(part))]
                    shard.add(len(open_docs) - 1, doc.n_words - len(tail), line)
                    doc.n_words += len(part)
                    tail = line[max(0, len(line) - width + 1) :]
                    if shard.size >= shard_words:
                        search()
                if shard.size >= shard_words or len(open_docs) >= shard_words:
                    search()
                    yield _finished(open_docs, known)
                    open_docs.clear()
        search()
        yield _finished(open_docs, known)

    return docs.mapInArrow(run, _FOUND)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    shard_words: int = SHARD,
    block_words: int = BLOCK_WORDS,
    keyed: bool = False,
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, spans), one row per row of `docs` (doc_id, text).

    `spans` are runs of words [start, stop) inside occurrences of windows of the `benchmark` (item_id, text), `items` the
    sorted names of the items that own these windows; `text_key` is the text's SHA-256 if `keyed`, or for several blocks.
    """
    blocks = benchmark_blocks(benchmark, block_words)
    keyed = keyed or len(blocks) > 1
    key = F.sha2("text", 256) if keyed else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")
    passes = []
    for block in blocks:
        items = block.orderBy("place").collect()  # a block's size is bounded
        phrases = phrases_of([(r.item, r.text.encode()) for r in items], width)
        passes.append(_pass(rows, phrases, width, shard_words))
    if len(passes) == 1:
        return passes[0]
    first = materialise(passes[0], "contamination")
    hits = [first, *(materialise(p.where("n_hit > 0"), "contamination") for p in passes[1:])]
    return _together(first, reduce(DataFrame.unionByName, hits).where("n_hit > 0"))


def _together(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows with the hits of all passes; rows with the same id and text have the same hits."""
    key = ["doc_id", "text_key"]
    spans = hits.select(*key, F.explode("spans").alias("s")).select(*key, "s.*").distinct()
    order = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy(*key).agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )
    items = hits.select(*key, F.explode("items").alias("item")).groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    whole = _met(rows.select(*key, "n_words"), _met(spans, items), "left")
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast(SPANS)
    return whole.select(
        *key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", no_items).alias("items"),
        F.coalesce("spans", no_spans).alias("spans"),
    )


def _met(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on id and text key, in which NULL equals NULL."""
    other = right.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & F.col("text_key").eqNullSafe(F.col("other_key"))
    return left.join(other, same, how).drop("other_id", "other_key")


def _cut(spans: Column, text: Column) -> Column:
    """The text without the words of the spans; white space and marks around them stay."""

    @F.pandas_udf("string")
    def cut(spans: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else without_words(t, [(x["start"], x["stop"]) for x in s]) for s, t in zip(spans, text, strict=True)])

    return cut(spans, text)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without what lies from the first to the last word of each span (sorted, apart)."""
    data, kept, at, n = text.encode(), [], 0, 0
    todo = iter(spans)
    span = next(todo, None)
    for start, part in pieces(data):
        for found in WORD.finditer(part):
            if span and n == span[0]:
                kept.append(data[at : start + found.start()])
            if span and n == span[1] - 1:
                at, span = start + found.end(), next(todo, None)
            n += 1
    return b"".join([*kept, data[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, **settings) -> DataFrame:
    """The rows of `docs` with all their columns, hit words cut out of their texts."""
    hits = contamination(docs, benchmark, width, keyed=True, **settings).where("n_hit > 0")
    hits = hits.select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    rows = docs.select(packed(docs.columns, "row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_key"))
    met = _met(rows, hits, "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_cut(F.col("spans"), F.col("row.text")))
    return met.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
