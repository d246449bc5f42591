"""N-gram Jaccard join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with the same set are one class, represented
by its smallest id; the join works on classes.

1. *Order.* One pass counts all tokens into a fixed number of buckets. Tokens of crowded buckets (passages that many
   documents share) come last in the order of tokens; any order gives the same links, this one keeps lists short.
2. *Groups of similar documents.* A class has `MINS` minimum hashes, each shared by two similar sets with the probability
   of their similarity, and goes with the one that most classes have. So nearly all of a family of N resembling documents
   meet in a few groups, which are cut into parts of about `GROUP` members (or `GROUP_TOKENS` tokens): N / `GROUP` groups,
   not N. A group holds one band of set sizes.
3. *Matrix.* (token, group) for each token of the prefixes of a group's members, with the sizes of the sets that have it.
   A prefix is so long that two sets above the threshold share k tokens of their prefixes, k being a share of their size
   (`SHARED`), so a pair of groups with fewer common entries, of sizes that can link, can't hold a link. Pairs of groups
   are formed, never pairs of documents.
4. *Bound.* A pair of groups is one row with the packed maps of the sets (`SKETCH_BITS` bits each) of both groups; the
   members that may have a partner in the other group are kept.
5. *Open.* A task gets the sets of the members kept, builds the groups' token unions, bounds every member's
   overlap with the other union, and opens the pair only for members that may reach the threshold. Their overlaps are
   counted exactly, by products of 0/1 matrices over blocks of shared tokens. Out come a spanning set of links and
   each member's number of links, at most one row for each member, never all pairs.
6. *Components* of the links, joined back to all documents through their class.

Every pair of classes meets in exactly one pair of groups, so no link is lost or counted twice; there is no cap on
groups, lists or candidates. The driver sees only the crowded buckets (at most `BUCKETS` numbers) and a bit map of fixed
size (`MARKS` bits) that marks the members of open pairs, so that the last pass over the texts leaves others out early.

Defined cases: NULL, empty and blank texts have no shingles, no class and no link; texts shorter than a shingle are
one shingle; rows with a NULL id keep a NULL component and link with nothing; rows that repeat an id and text count as
one class with several rows, rows that repeat an id with another text are judged each by its own set; an empty table
gives no rows; extra columns are ignored here, `one_of_each_group` keeps them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.text import packed
from quantloom.storage import discard, materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 18
#: A group has at most about so many members, or fewer that have so many tokens.
GROUP, GROUP_TOKENS = 512, 1 << 19
#: Part of a set that two similar sets share in their prefixes at least; the longer the prefixes, the fewer the pairs.
SHARED = 0.03
#: Bits of the map of a set by which overlaps are bounded before sets are sent.
SKETCH_BITS = 2048
#: Bits that mark documents; two documents on one bit only cost work.
MARKS = 1 << 26
#: Bytes of text that are hashed at once; columns of the 0/1 matrices at once.
BLOCK_BYTES, BLOCK_COLUMNS = 1 << 20, 1 << 14

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Odd factors: the smallest product of each names a set's minimum hashes.
MINS = (_STEP, _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in these bytes: the sum of one pseudo-random number for each byte and its place."""
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U), starts
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    drawn = _mix((place.astype(_U) << _U(8)) + _LOWER[data[~gap]].astype(_U) + _STEP)
    return _mix(np.add.reduceat(drawn, firsts) + sizes.astype(_U) * _STEP), starts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each text, and the text of each."""
    hashes, owner = [], []
    begin = 0
    for stop in range(1, len(texts) + 1):
        size = sum(map(len, texts[begin:stop]))
        if stop < len(texts) and size + len(texts[stop]) < BLOCK_BYTES:
            continue
        data = np.frombuffer(b" ".join(texts[begin:stop]) + b" ", np.uint8)
        bounds = np.cumsum([len(t) + 1 for t in texts[begin:stop]])
        at = 0
        while at < len(data):
            # Long texts are cut behind a gap, so that no word is split.
            end = min(len(data), at + 4 * BLOCK_BYTES)
            if end < len(data):
                gaps = np.flatnonzero(_GAP[data[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else at + int(np.flatnonzero(_GAP[data[at:]])[0]) + 1
            h, starts = _word_hashes(data[at:end])
            hashes.append(h)
            owner.append(begin + np.searchsorted(bounds, starts + at, side="right"))
            at = end
        begin = stop
    if not hashes:
        return np.empty(0, _U), np.empty(0, np.int64)
    h, doc = np.concatenate(hashes), np.concatenate(owner)
    counts = np.bincount(doc, minlength=len(texts))
    token, token_doc = np.empty(0, _U), np.empty(0, np.int64)
    if len(h) >= width:
        n = len(h) - width + 1
        token = h[:n].copy()
        for k in range(1, width):
            token = _mix(token * _STEP + h[k : k + n])
        inside = doc[:n] == doc[width - 1 :]
        token, token_doc = token[inside], doc[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        ends = np.cumsum(counts)
        extra = []
        for d in short:
            folded = h[ends[d] - counts[d] : ends[d]]
            value = folded[:1].copy()
            for k in range(1, len(folded)):
                value = _mix(value * _STEP + folded[k : k + 1])
            extra.append(_mix(value + _U(len(folded)))[0])
        token, token_doc = np.r_[token, np.array(extra, _U)], np.r_[token_doc, short]
    order = np.argsort(token)
    order = order[np.argsort(token_doc[order].astype(np.uint16), kind="stable")]  # few texts at once: a radix sort
    token, token_doc = token[order], token_doc[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (token_doc[1:] != token_doc[:-1])][: len(token)]
    return token[new], token_doc[new]


def _batches(batches: Iterator[pa.RecordBatch], width: int, rows: int = 256):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            texts = [(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield part, *shingle_sets(texts, width)


def _bucket(token: np.ndarray) -> np.ndarray:
    return (token >> _U(64 - 18)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def crowded_buckets(docs: DataFrame, width: int) -> np.ndarray:
    """For each bucket, whether its tokens come last in the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, token, _ in _batches(batches, width):
            total += np.bincount(_bucket(token), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "jaccard-buckets")
    whole = counts.agg(F.sum("n").alias("tokens")).first()
    flags = np.zeros(BUCKETS, bool)
    mean = (whole.tokens or 0) / BUCKETS
    limit = mean + 6 * mean**0.5 + 16  # beyond what chance puts into a bucket
    for row in counts.where(F.col("n") > limit).select("bucket").toLocalIterator():
        flags[row.bucket] = True
    discard(counts)
    return flags


def _least_overlap(n: np.ndarray | int, percent: int):
    """Tokens that a partner must share at least with a set of n."""
    return (percent * n + 99) // 100


def _signatures(docs: DataFrame, width: int, percent: int, crowded) -> DataFrame:
    """doc_id, n, two sums that name the set, its minimum hashes, k, its prefix (of which similar sets share k), its map.

    Of a token in a prefix 48 bits are enough: prefixes only find pairs of groups.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = crowded.value
        for part, token, doc in _batches(batches, width):
            n = np.bincount(doc, minlength=part.num_rows)
            ends = np.cumsum(n)
            some = np.flatnonzero(n)
            first = (ends - n)[some]
            sums = np.zeros((2, part.num_rows), _U)
            mins = np.zeros((part.num_rows, len(MINS)), _U)
            if len(some):
                sums[0, some] = np.add.reduceat(_mix(token), first)
                sums[1, some] = np.add.reduceat(_mix(token ^ _STEP), first)
                for i, factor in enumerate(MINS):
                    mins[some, i] = np.minimum.reduceat(token * factor, first)
            order = np.argsort((2 * doc + late[_bucket(token)]).astype(np.uint16), kind="stable")
            overlap = _least_overlap(n, percent)
            k = np.minimum(1 + (SHARED * n).astype(np.int64), overlap)
            length = np.where(n > 0, n - overlap + k, 0)
            place = np.arange(len(token)) - np.repeat(ends - n, n)
            prefix = token[order][place < np.repeat(length, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), _signed(prefix >> _U(16)))
            bits = np.zeros((part.num_rows, SKETCH_BITS), bool)
            bits[doc, (token & _U(SKETCH_BITS - 1)).astype(np.int64)] = True
            sketches = [row.tobytes() for row in np.packbits(bits, axis=1)]
            least = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(MINS)), _signed(mins.ravel()))
            columns = [part.column("doc_id"), pa.array(n), *map(_signed, sums), least, pa.array(k), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sum1", "sum2", "mins", "k", "prefix", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n long, sum1 long, sum2 long, mins array<long>, k long, prefix array<long>, sketch binary"
    )


def _marks(ids: DataFrame) -> np.ndarray:
    """A map of `MARKS` bits with the bits of these ids set; `bit` is computed by `_bit`."""
    maps = ids.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for row in maps.toLocalIterator():  # at most MARKS / 32768 rows of 4 KB
        start = (row["at"] - 1) * 4096
        marks[start : start + 4096] = np.frombuffer(row["map"], np.uint8)
    return marks


def _bit(doc_id: str) -> Column:
    return (F.pmod(F.xxhash64(doc_id), F.lit(MARKS)) + 1).cast("long")


def _token_rows(docs: DataFrame, width: int, marked) -> DataFrame:
    """doc_id, n, sum1, sum2 and the whole set as bytes, of the marked documents (doc_id, text, bit)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marked.value
        for batch in batches:
            place = batch.column("bit").to_numpy() - 1
            chosen = batch.filter(pa.array((marks[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1))
            for part, token, doc in _batches([chosen], width):
                n = np.bincount(doc, minlength=part.num_rows)
                ends = np.cumsum(n)
                some = np.flatnonzero(n)
                sums = np.zeros((2, part.num_rows), _U)
                if len(some):
                    sums[0, some] = np.add.reduceat(_mix(token), (ends - n)[some])
                    sums[1, some] = np.add.reduceat(_mix(token ^ _STEP), (ends - n)[some])
                data = [_packed(t) for t in np.split(token, ends[:-1])]
                columns = [part.column("doc_id"), pa.array(n), *map(_signed, sums), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sum1", "sum2", "tokens"])

    return docs.mapInArrow(rows, "doc_id long, n long, sum1 long, sum2 long, tokens binary")


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").astype(_U)


def _incidence(tokens: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 matrix: which of the sorted columns each set has."""
    out = np.zeros((len(tokens), len(columns)), np.float32)
    for i, t in enumerate(tokens):
        at = np.searchsorted(columns, t)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == t]] = 1
    return out


def open_groups(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two groups, or inside one group (right is None), as pairs of places."""
    others = left if right is None else right
    if right is None:
        union, times = np.unique(np.concatenate(left), return_counts=True)
        shared = union[times > 1]
    else:
        shared = np.intersect1d(*[np.unique(np.concatenate(side)) for side in (left, others)], assume_unique=True)
    if not len(shared):
        return []
    sizes = [np.array([len(t) for t in side]) for side in (left, others)]
    # Bound: what a member shares with the other group's union.
    keep = []
    for side, n in ((left, sizes[0]), (others, sizes[1])):
        bound = np.array([int(np.isin(t, shared, assume_unique=True).sum()) for t in side])
        keep.append(np.flatnonzero(bound >= _least_overlap(n, percent)))
    if not len(keep[0]) or not len(keep[1]):
        return []
    a, b = [left[i] for i in keep[0]], [others[i] for i in keep[1]]
    common = np.zeros((len(a), len(b)), np.int64)
    for start in range(0, len(shared), BLOCK_COLUMNS):
        block = shared[start : start + BLOCK_COLUMNS]
        rows = _incidence(a, block)
        common += (rows @ (rows if right is None else _incidence(b, block)).T).astype(np.int64)
    union = sizes[0][keep[0]][:, None] + sizes[1][keep[1]][None, :] - common
    linked = 100 * common >= percent * union
    if right is None:
        linked = np.triu(linked, 1)
    return [(int(keep[0][i]), int(keep[1][j])) for i, j in zip(*np.nonzero(linked), strict=True)]


def _opened(pairs: DataFrame, percent: int) -> DataFrame:
    """u, v, n: links that span what the pair of groups connects (n NULL), and links of each member (v NULL)."""

    def results(a: int, b: int, rows: list[tuple]) -> tuple[list, list, list]:
        sides = [[r for r in rows if r[0] == side] for side in (a, b)]
        sets = [[_unpacked(r[3]) for r in side] for side in sides]
        found = open_groups(sets[0], None if a == b else sets[1], percent)
        count: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        u, v, n = [], [], []
        for i, j in found:
            (_, x, wx, _), (_, y, wy, _) = sides[0][i], sides[0 if a == b else 1][j]
            count[x] = count.get(x, 0) + wy
            count[y] = count.get(y, 0) + wx
            if root(x) != root(y):
                parent[root(x)] = root(y)
                u, v, n = [*u, x], [*v, y], [*n, None]
        return [*u, *count], [*v, *[None] * len(count)], [*n, *count.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "n"])
            for c in out:
                c.clear()
            return made

        for (a, b), rows in _runs(batches, ("g", "doc_id", "weight", "tokens")):
            for c, more in zip(out, results(a, b, rows), strict=True):
                c.extend(more)
            if len(out[0]) > 10_000:
                yield batch()
        yield batch()

    dealt = pairs.repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(run, "u long, v long, n long")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """The rows of each pair (a, b) in turn; rows come sorted by pair."""
    now, rows = None, []
    for part in batches:
        columns = [part.column(c).to_pylist() for c in ("a", "b", *names)]
        for a, b, *row in zip(*columns, strict=True):
            if (a, b) != now:
                if rows:
                    yield now, rows
                now, rows = (a, b), []
            rows.append(row)
    if rows:
        yield now, rows


_MEMBER = ("doc_id", "n", "sum1", "sum2", "weight")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """The members of pairs of groups that the maps of their sets leave a possible partner in the other group.

    `pairs` has a, b and both groups' members as arrays (`others` is NULL inside a group). A bit that is set in one map only
    stands for at least one token of that set only, and of those a pair above the threshold has few: so no link is lost.
    """

    def possible(left: list[dict], right: list[dict], inside: bool) -> np.ndarray:
        maps = [np.unpackbits(np.frombuffer(b"".join(m["sketch"] for m in side), np.uint8)).reshape(len(side), -1).astype(np.float32) for side in (left, right)]
        n = [np.array([m["n"] for m in side], np.int64) for side in (left, right)]
        common = (maps[0] @ maps[1].T).astype(np.int64)
        least = (percent * (n[0][:, None] + n[1][None, :]) + 99 + percent) // (100 + percent)
        only = [m.sum(axis=1).astype(np.int64) for m in maps]
        found = (only[0][:, None] - common <= n[0][:, None] - least) & (only[1][None, :] - common <= n[1][None, :] - least)
        if inside:
            np.fill_diagonal(found, False)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                left = batch.column("members")[i].as_py()
                right = left if a == b else batch.column("others")[i].as_py()
                found = possible(left, right, a == b)
                kept = [(a, m) for m, hit in zip(left, found.any(axis=1), strict=True) if hit]
                if a != b:
                    kept += [(b, m) for m, hit in zip(right, found.any(axis=0), strict=True) if hit]
                columns = [pa.array([x] * len(kept), pa.int64()) for x in (a, b)]
                columns += [pa.array([g for g, _ in kept], pa.int64())]
                columns += [pa.array([m[c] for _, m in kept], pa.int64()) for c in _MEMBER]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "g", *_MEMBER])

    return pairs.mapInArrow(run, ", ".join(f"{c} long" for c in ("a", "b", "g", *_MEMBER)))


def grouped(classes: DataFrame, percent: int) -> DataFrame:
    """(n, sum1, sum2, rep, weight, g): the group of each class (n, sum1, sum2, rep, weight, mins)."""
    name = ["n", "sum1", "sum2"]
    hashes = classes.select(*name, "rep", "weight", F.posexplode("mins").alias("which", "least"))
    popular = hashes.groupBy("which", "least").agg(F.count("*").alias("held")).where("held > 1")
    # Of several equally popular hashes the first; a class that shares none is a group of its own.
    best = F.max_by(F.struct("which", "least"), F.struct("held", (-F.col("which")).alias("first"))).alias("best")
    chosen = hashes.join(popular, ["which", "least"]).groupBy(*name).agg(best)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("band")
    keyed = classes.join(chosen, name, "left").select(
        *name, "rep", "weight", F.when(F.col("best").isNull(), F.xxhash64(*name)).otherwise(F.xxhash64("best.which", "best.least")).alias("family"), band
    )
    parts = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS))
    many = keyed.groupBy("family", "band").agg(parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    return keyed.join(many, ["family", "band"], "left").select(
        *name, "rep", "weight", F.shiftrightunsigned(F.xxhash64("family", "band", part), 24).alias("g")
    )


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, n_links."""
    spark = docs.sparkSession
    crowded = spark.sparkContext.broadcast(crowded_buckets(docs, width))
    signed = materialise(_signatures(docs, width, percent, crowded), "jaccard-sets")
    name = ["n", "sum1", "sum2"]
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy(*name).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("mins").alias("mins")
    )
    classes = materialise(classes, "jaccard-classes")
    members = materialise(grouped(classes, percent), "jaccard-members")
    discard(classes)
    entries = (
        signed.where("n > 0")
        .select(F.col("doc_id").alias("rep"), *name, "k", "prefix")
        .join(members.select("rep", *name, "g"), ["rep", *name])
        .dropDuplicates(["rep", *name])
        .select("rep", "g", "n", "k", F.explode("prefix").alias("token"))
    )
    matrix = (
        entries.groupBy("token", "g")
        .agg(F.count("*").alias("docs"), F.min("k").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    )
    # A token of one document links nothing: nine in ten rows of the matrix go here. What is left of a token has one
    # row for each group, not for each document.
    matrix = matrix.withColumn("all", F.sum("docs").over(Window.partitionBy("token"))).where("all > 1").drop("all")
    matrix = materialise(matrix, "jaccard-matrix")
    sizes = f"{percent} * x.low <= 100 * y.high AND {percent} * y.low <= 100 * x.high"
    pairs = (
        matrix.alias("x")
        .join(matrix.alias("y"), F.expr(f"x.token = y.token AND (x.g < y.g OR (x.g = y.g AND x.docs > 1)) AND {sizes}"))
        .groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b"))
        .agg(F.count("*").alias("common"), F.min(F.least("x.k", "y.k")).alias("k"))
        .where("common >= k")
        .select("a", "b")
    )
    pairs = materialise(pairs, "jaccard-pairs")
    discard(matrix)
    met = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct()
    sketches = signed.where("n > 0").select(F.col("doc_id").alias("rep"), *name, "sketch")
    packed_groups = (
        members.join(met, "g")
        .join(sketches, ["rep", *name])
        .dropDuplicates(["rep", *name])
        .groupBy("g")
        .agg(F.collect_list(F.struct(F.col("rep").alias("doc_id"), *name, "weight", "sketch")).alias("members"))  # about `GROUP`
    )
    packed_groups = materialise(packed_groups, "jaccard-groups")
    others = packed_groups.select(F.col("g").alias("b"), F.col("members").alias("others"))
    inside = pairs.where("a = b").withColumn("others", F.lit(None).cast(others.schema["others"].dataType))
    across = pairs.where("a < b").join(others, "b").select("a", "b", "others")
    rows = inside.unionByName(across).join(packed_groups.withColumnRenamed("g", "a"), "a")
    wanted = materialise(_bounded(rows.select("a", "b", "members", "others"), percent), "jaccard-wanted")
    discard(packed_groups)
    discard(pairs)
    marked = spark.sparkContext.broadcast(_marks(wanted.select(_bit("doc_id").alias("bit"))))
    tokens = _token_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text", _bit("doc_id").alias("bit")), width, marked)
    # Rows that repeat an id and a set are one member.
    tokens = tokens.dropDuplicates(["doc_id", *name])
    opened = _opened(tokens.join(wanted, ["doc_id", *name]).drop(*name), percent)
    opened = materialise(opened, "jaccard-links")
    discard(wanted)
    found = components(opened.where("v IS NOT NULL").select("u", "v"))
    counts = opened.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    labelled = (
        members.select(*name, "rep", "weight")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .select(
            *name,
            F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        )
    )
    has_id = F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", *name)
        .join(labelled, name, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(has_id, F.coalesce("component", "doc_id")).alias("component_id"),
            F.when(has_id, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
        )
    )


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: the smallest id of each component and all rows without an id, with all columns."""
    found = jaccard_components(docs, width, percent)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(packed(docs.columns, "row"), F.col("doc_id").alias("row_id"))
    stay = rows.where("row_id IS NOT NULL").join(kept, F.col("row_id") == F.col("kept_id"), "left_semi")
    # Rows that repeat an id and its text are one; another text under the same id stays beside it.
    one = stay.withColumn("digest", F.sha2("row.text", 256)).dropDuplicates(["row_id", "digest"])
    return one.select("row.*").unionByName(docs.where("doc_id IS NULL"))
