"""Language identification by fusing evidence in Bayes' rule.

* Text: a multinomial for each language over hashed features (words, first and last three bytes of words), counted over
  every document with a declared language.
* Declaration (the markup's lang attribute, or the table's lang column): how often each language is declared so, counted
  over all rows by the language that the text alone suggests.
* Address suffix (the last label of the host): likewise.
* Host prior: the host's languages, smoothed towards its domain's, and these towards the whole corpus.

The three tables are grouped aggregates. A row is joined with one row of each by declaration, suffix and host;
partial aggregation keeps a host with very many pages from meeting in one task, and adaptive execution may
split its rows in the join, whose other side has one row for each host. Only the text model reaches the driver:
every declared language times `BUCKETS`. A declaration is reduced to its primary subtag (`en-US` and `en_GB` are `en`)
of two or three letters, so there are at most 18,252 of them; `und`, `zxx`, `mul` and `mis` name no language.

Defined cases: NULL and empty texts have no text evidence, the prior decides; a NULL or unreadable url has an empty host
and suffix; a missing declaration is a value of its own; without any declared language the result is NULL with
probability NULL; ties go to the first language by name; repeated rows get the same result; empty tables give no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.jaccard import _mix
from quantloom.storage import materialise

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
#: Weight of the smoothing level above, in rows; features that a text counts for at most.
KAPPA, TEXT_WEIGHT = 5.0, 40.0

#: A declaration's primary subtag: it ends with the declaration or before what isn't a letter or digit.
_PRIMARY = r"(?i)^[ \t\r\n]*([a-z]{2,3})(?:[^a-z0-9].*)?$"
#: Codes that say that a language is unknown, absent, mixed or without a code.
NO_LANGUAGE = ("und", "zxx", "mul", "mis")

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKUP = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def features(text: bytes) -> np.ndarray:
    """Bucket of each feature of a text."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, _LETTER[data], False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.int64)
    summed = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=summed[1:])
    back = _powers(_INVERSE, len(data))
    parts = [(starts, ends), (starts, np.minimum(starts + 3, ends)), (np.maximum(ends - 3, starts), ends)]
    hashed = [_mix((summed[e] - summed[s]) * back[s] + _U(kind * 0x1000193)) for kind, (s, e) in enumerate(parts)]
    return (np.concatenate(hashed) >> _U(50)).astype(np.int64)


def _text_of(value: str | None, markup: bool) -> bytes:
    return (_MARKUP.sub(" ", value) if markup and value else value or "").encode()


def primary(lang: Column) -> Column:
    """The primary subtag of a declaration in small letters, empty if it names no language."""
    return F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), f"(?s){_PRIMARY}", 1))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket in each, from all documents (text, lang)."""
    named = docs.select("text", primary(F.col("lang")).alias("lang")).where((F.col("lang") != "") & ~F.col("lang").isin(*NO_LANGUAGE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS + 1, np.int64)
                totals[lang][:BUCKETS] += np.bincount(features(_text_of(text.as_py(), False)), minlength=BUCKETS)
                totals[lang][BUCKETS] += 1
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"])

    counts = named.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-counts")
    languages = sorted(r.lang for r in counts.where(F.col("bucket") == BUCKETS).select("lang").collect())
    table = np.zeros((len(languages), BUCKETS), np.float32)
    place = {lang: i for i, lang in enumerate(languages)}
    for r in counts.where(F.col("bucket") < BUCKETS).toLocalIterator() if languages else ():
        table[place[r.lang], r.bucket] = r.n
    # What a language lacks is as likely in each, so that unknown words don't speak for the language with the fewest texts.
    totals = table.sum(axis=1, dtype=np.float64)
    lacking = 0.5 / (totals.max(initial=0.0) + 0.5 * BUCKETS)
    for row, total in zip(table, totals, strict=True):
        row[:] = np.log(lacking + row * ((1 - BUCKETS * lacking) / max(total, 1.0)))
    return languages, table


def _with_text_evidence(rows: DataFrame, languages: list[str], model: np.ndarray, markup: bool) -> DataFrame:
    """The other columns of `rows` with `evidence`, the tempered log likelihood of each language."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T.astype(np.float32)))
    names = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out = np.zeros((part.num_rows, table.shape[1]))
                for i, text in enumerate(part.column("text")):
                    found = features(_text_of(text.as_py(), markup))
                    if len(found):
                        times = np.bincount(found, minlength=BUCKETS)
                        used = np.flatnonzero(times)
                        total = times[used].astype(np.float64) @ table[used]
                        out[i] = (total - total.max()) * min(1.0, TEXT_WEIGHT / len(found))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), table.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], lists], [*names, "evidence"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(score, f"{kinds}, evidence array<double>")


def _best(values: str) -> Column:
    """Place of the largest value, the first of equal ones."""
    return (F.array_position(F.col(values), F.array_max(values)) - 1).cast("int")


def _counts(rows: DataFrame, *keys: str, size: int) -> DataFrame:
    """Per key the number of rows by suggested language, as an array."""
    return rows.groupBy(*keys).agg(*[F.sum((F.col("suggested") == i).cast("double")).alias(f"n{i}") for i in range(size)]).select(
        *keys, F.array(*[f"n{i}" for i in range(size)]).alias("n")
    )


def _smoothed(n: str, above: str) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(F.arrays_zip(F.col(n).alias("n"), F.col(above).alias("p")), lambda x: (x["n"] + KAPPA * x["p"]) / (total + KAPPA))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """`rows` (declared, suffix, domain, host, evidence and others) with lang, probability and text_lang."""
    size = len(languages)
    if not size:
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    rows = materialise(rows.withColumn("suggested", _best("evidence")), "language-evidence")
    flat = F.aggregate("evidence", F.lit(0.0), lambda acc, x: acc + F.abs(x)) > 0
    spoken = rows.where(flat)  # rows without text suggest nothing
    overall = _counts(spoken, size=size).select(F.col("n").alias("by_language"))
    uniform = F.array(*[F.lit(1.0 / size)] * size)
    base = overall.select("by_language", uniform.alias("u")).select("by_language", _smoothed("by_language", "u").alias("base"))
    base = base.select(F.coalesce("by_language", F.array(*[F.lit(0.0)] * size)).alias("by_language"), F.coalesce("base", uniform).alias("base"))

    def likelihood(column: str) -> DataFrame:
        """log P(value | language), smoothed towards the value's share of all rows."""
        n = _counts(spoken, column, size=size)
        whole = F.aggregate("by_language", F.lit(0.0), lambda acc, x: acc + x)
        share = (F.aggregate("n", F.lit(0.0), lambda acc, x: acc + x) + 1) / (whole + 1)
        found = F.transform(F.arrays_zip("n", "by_language"), lambda x: F.ln((x["n"] + KAPPA * share) / (x["by_language"] + KAPPA)))
        return n.crossJoin(F.broadcast(base)).select(column, found.alias(f"by_{column}"))

    domains = _counts(spoken, "domain", size=size).crossJoin(F.broadcast(base)).select("domain", _smoothed("n", "base").alias("of_domain"))
    hosts = _counts(spoken, "host", "domain", size=size).join(domains, "domain").select("host", F.transform(_smoothed("n", "of_domain"), F.ln).alias("by_host"))
    fallback = F.transform("base", F.ln)
    none = F.array(*[F.lit(0.0)] * size)
    joined = (
        rows.join(likelihood("declared"), "declared", "left")
        .join(likelihood("suffix"), "suffix", "left")
        .join(hosts, "host", "left")
        .crossJoin(F.broadcast(base))
    )
    others = [c for c in rows.columns if c not in ("evidence", "suggested")]
    posterior = F.transform(
        F.arrays_zip(
            F.col("evidence").alias("a"),
            F.coalesce("by_declared", none).alias("b"),
            F.coalesce("by_suffix", none).alias("c"),
            F.coalesce("by_host", fallback).alias("d"),
        ),
        lambda x: x["a"] + x["b"] + x["c"] + x["d"],
    )
    named = F.array(*map(F.lit, languages))
    scored = joined.select(*others, "suggested", flat.alias("has_text"), posterior.alias("posterior"))
    scored = scored.select("*", F.array_max("posterior").alias("top"))
    mass = F.aggregate(F.transform("posterior", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(
        *others,
        F.get(named, _best("posterior")).alias("lang"),
        (1 / mass).alias("probability"),
        F.when(F.col("has_text"), F.get(named, F.col("suggested"))).alias("text_lang"),
    )


def _address(url: Column) -> list[Column]:
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return [F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"), host.alias("host")]


def languages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and page: doc_id, page_id (one of them NULL), lang, probability, text_lang."""
    languages, model = text_model(docs)
    missing = F.lit("")
    source = F.concat(F.lit("source:"), F.coalesce("source", missing))
    from_docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        F.concat(F.lit("table:"), F.coalesce(F.nullif(primary(F.col("lang")), F.lit("")), F.lower(F.coalesce("lang", missing)))).alias("declared"),
        F.lit("").alias("suffix"),
        F.lit("documents").alias("domain"),
        source.alias("host"),
        "text",
    )
    declared = F.lower(F.regexp_extract(F.coalesce("html", missing), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    from_pages = pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit("markup:"), declared).alias("declared"),
        *_address(F.col("url")),
        F.col("html").alias("text"),
    )
    if not languages:
        model = np.zeros((1, BUCKETS))
    rows = _with_text_evidence(from_docs, languages, model, False).unionByName(
        _with_text_evidence(from_pages, languages, model, True)
    )
    return fuse(rows, languages).select("doc_id", "page_id", "lang", "probability", "text_lang")
