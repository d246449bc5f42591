"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, on built-in functions only.

The ratio compares two multinomials over hashed words and word pairs: the trusted target (documents labelled as quality 1)
and the raw corpus (all documents). Both are counted over every document in one pass. A document's score is the mean log
ratio of its n-grams, less that of all n-grams of its declared language, so that long texts are judged like short ones and
a language that few labels cover like any other; a fixed threshold decides on each document by itself.

* Shares are mixed, (target + BACKING * raw) / (1 + BACKING), in relation to sizes: a corpus twice as large with twice the
  labels gives the same scores, and an n-gram that the target lacks counts as ln(BACKING / (1 + BACKING)), not minus infinity.
* A trusted document's own n-grams are taken out of the target before it is scored, so labels can't vouch for themselves.

What is counted fills arrays of fixed length (2 x BUCKETS, LANGUAGES) that reach the tasks as scalar subqueries: their size
doesn't depend on the corpus. Labels reach the documents through a bit map of fixed size: only documents that may be
trusted are shuffled, to meet their label; counts are combined before they are shuffled.

Defined cases: a NULL or empty text has no words, fails the base rules and is rejected, its ratio is 0; labels that
are NULL or missing count as untrusted, repeated labels count once; NULL and empty languages are one; without any label
all ratios are 0; repeated rows are judged alike; an empty corpus gives no rows; extra columns are carried along by
`good_documents`, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.marks import marks_of, with_mark
from quantloom.llm.text import packed, whole, words
from quantloom.storage import materialise

#: Buckets for single words, and as many again for pairs.
BUCKETS = 65_536
#: Buckets for declared languages; languages on one bucket share their mean.
LANGUAGES = 4_096
#: Mean log ratio, less that of the language, that a document has to reach.
THRESHOLD = -0.25
#: Weight of the corpus beside the target in the target's multinomial.
BACKING = 0.1
#: Places of words that fit beside a hash.
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS


def n_grams(word_hashes: str) -> Column:
    """Bucket numbers of all words and pairs; `word_hashes` must be a computed column."""
    hashes = F.col(word_hashes)
    pairs = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: (h * 31 + F.get(F.col(word_hashes), i + 1)) % BUCKETS + BUCKETS,
    )
    return F.concat(hashes, pairs)


def _word_hashes(words_column: str) -> Column:
    """CRC-32 of each word: the same in every language and engine."""
    return F.transform(F.col(words_column), lambda w: (F.crc32(w) % BUCKETS).cast("int"))


def language_bucket(lang: Column) -> Column:
    return (F.crc32(F.coalesce(lang, F.lit("")).cast("binary")) % LANGUAGES).cast("int")


def with_trust(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, trusted): packed rows (`row`, with doc_id) and whether a label calls them quality 1.

    Rows that the labels' bit map doesn't mark stay where they are.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()
    marks = marks_of(trusted.select(F.xxhash64("trusted_id").alias("hashed")), "hashed")
    hashed = F.when(F.col("row.doc_id").isNotNull(), F.xxhash64("row.doc_id"))
    met = with_mark(rows.select("row"), hashed, marks)
    maybe = met.where("marked").withColumn("row_id", F.col("row.doc_id"))
    found = maybe.join(trusted.hint("shuffle_hash"), F.col("row_id") == F.col("trusted_id"), "left")
    return met.where(~F.col("marked")).select("row", F.lit(False).alias("trusted")).unionByName(
        found.select("row", F.col("trusted_id").isNotNull().alias("trusted"))
    )


def ratio_model(rows: DataFrame, backing: float = BACKING) -> DataFrame:
    """One stored row from (row, trusted): `weights`, the log ratio of each bucket, `target` and `scale`, the parts that it
    is made of, `all_target`, and `means`, the mean weight in each language."""
    counted = (
        rows.select(words(F.col("row.text")).alias("words"), language_bucket(F.col("row.lang")).alias("lang"), F.col("trusted").cast("long"))
        .select(_word_hashes("words").alias("hashes"), "lang", "trusted")
        .select(n_grams("hashes").alias("grams"), "lang", "trusted")
        # The outer form: else the optimizer infers a filter on the array's size and computes the n-grams twice.
        .select(F.explode_outer("grams").alias("bucket"), "lang", "trusted")
        .where("bucket IS NOT NULL")
        .groupBy("lang", "bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    counted = materialise(counted, "quality-counts")
    spark = rows.sparkSession
    totals = counted.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    scale = F.col("all_raw") / F.greatest(F.coalesce("raw", F.lit(0)), F.lit(1)).cast("double")
    buckets = (
        spark.range(2 * BUCKETS)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(sums, "bucket", "left")
        .crossJoin(F.broadcast(totals))
        .select("bucket", F.coalesce("target", F.lit(0)).alias("target"), scale.alias("scale"), "all_target")
        .withColumn("weight", _log_ratio(F.col("target"), F.col("all_target"), F.col("scale"), backing))
    )
    buckets = materialise(buckets, "quality-buckets")
    mean = F.sum(F.col("raw") * F.col("weight")) / F.sum("raw")
    means = counted.join(F.broadcast(buckets.select("bucket", "weight")), "bucket").groupBy("lang").agg(mean.alias("mean"))
    languages = spark.range(LANGUAGES).select(F.col("id").cast("int").alias("lang")).join(means, "lang", "left")
    ordered = lambda by, value: F.transform(F.sort_array(F.collect_list(F.struct(by, F.col(value).alias("v")))), lambda x: x["v"])
    arrays = buckets.agg(
        ordered("bucket", "weight").alias("weights"),
        ordered("bucket", "target").alias("target"),
        ordered("bucket", "scale").alias("scale"),
        F.max("all_target").alias("all_target"),
    )
    spoken = languages.select("lang", F.coalesce("mean", F.lit(0.0)).alias("mean")).agg(ordered("lang", "mean").alias("means"))
    return materialise(arrays.crossJoin(F.broadcast(spoken)), "quality-model")


def _log_ratio(target: Column, all_target: Column, scale: Column, backing: float) -> Column:
    """ln of the backed share in the target by the share in the corpus; `scale` is one by the latter."""
    return F.log((target / F.greatest(all_target, F.lit(1)).cast("double") * scale + backing) / (1 + backing))


def _covered(repeats: Column) -> Column:
    """Words covered by 3-word windows that begin at these sorted places."""
    reach = F.transform(
        repeats, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("repeats"), i + 1) - p, F.lit(3)))
    )
    return F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x)


def base_counts(rows: DataFrame) -> DataFrame:
    """(row, trusted) with hashes of the words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = whole(F.col("row.text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    start = rows.select(
        "row",
        "trusted",
        words(F.col("row.text")).alias("words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("words")
    counts = start.select(
        "row",
        "trusted",
        "words",
        _word_hashes("words").alias("hashes"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    kept = ["row", "trusted", "words", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = F.transform(
        F.slice("words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)),
    )
    hashed = counts.select(*kept, windows.alias("windows"))
    # Windows with equal hashes, by hash and place: the high bits of the hash and the place in one number.
    placed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(-PLACES)).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<bigint>")
    ordered = hashed.select(
        *kept, F.when(F.size("windows") > F.size(F.array_distinct("windows")), placed).otherwise(none).alias("placed")
    )
    run = lambda x: F.shiftright(x, PLACE_BITS)
    beside = lambda name, i: run(F.get(F.col(name), i))
    in_run = lambda x, i: F.coalesce(run(x) == beside("placed", i - 1), F.lit(False)) | F.coalesce(
        run(x) == beside("placed", i + 1), F.lit(False)
    )
    runs = ordered.select(*kept, F.filter("placed", in_run).alias("runs"))
    place = lambda x: x.bitwiseAND(F.lit(PLACES - 1)).cast("int")
    word = lambda at: F.get(F.col("words"), at)

    def differs(x: Column, i: Column) -> Column:
        """The window and the one before it have the same hash but not the same words."""
        here, there = place(x), place(F.get(F.col("runs"), i - 1))
        same = (word(here) == word(there)) & (word(here + 1) == word(there + 1)) & (word(here + 2) == word(there + 2))
        return F.coalesce((run(x) == beside("runs", i - 1)) & ~same, F.lit(False))

    # Hashes stand for words unless two different windows share one; then (or in endless texts) the words are sorted.
    unsure = F.exists(F.transform("runs", differs), lambda x: x) | (n >= PLACES)
    spelt = F.transform(
        F.slice("words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, word(i + 1), word(i + 2)).alias("w"), i.alias("at")),
    )
    empty = F.array().cast("array<struct<w:string,at:int>>")
    checked = runs.select(*kept, "runs", F.when(unsure, F.sort_array(spelt)).alias("spelt"))
    near = lambda i: F.get(F.col("spelt"), i)["w"]
    by_words = F.transform(
        F.filter(
            F.coalesce("spelt", empty),
            lambda x, i: F.coalesce(x["w"] == near(i - 1), F.lit(False)) | F.coalesce(x["w"] == near(i + 1), F.lit(False)),
        ),
        lambda x: x["at"],
    )
    repeats = F.sort_array(F.when(F.col("spelt").isNull(), F.transform("runs", place)).otherwise(by_words))
    kept.remove("words")
    return checked.select(*kept, repeats.alias("repeats")).select(*kept, _covered(F.col("repeats")).alias("n_repeat_words"))


def _ratio_sum(target: str, scale: str, weights: str, all_target: Column, backing: float) -> Column:
    """Sum of the log ratios of the n-grams in `grams`; those of a trusted text (sorted, first places in `firsts`) without itself.

    Each array is read once, so that the optimizer folds its subquery into the lambda and never copies it into a row.
    """
    n = F.size("grams")
    times = lambda at, i: F.coalesce(F.get(F.col("firsts"), i + 1), n) - at

    def left_out(at: Column, i: Column) -> Column:
        gram, count = F.get(F.col("grams"), at), times(at, i)
        rest = F.greatest(all_target - n, F.lit(1))
        return count * _log_ratio(F.get(F.col(target), gram) - count, rest, F.get(F.col(scale), gram), backing)

    added = lambda acc, x: acc + x
    own = F.aggregate(F.transform("firsts", left_out), F.lit(0.0), added)
    other = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(F.col(weights), g))
    return F.when(F.col("firsts").isNotNull(), own).otherwise(other)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, backing: float = BACKING
) -> DataFrame:
    """`row` with n_words, the base counts, base_failed, ratio and kept."""
    rows = with_trust(docs.select(packed(docs.columns, "row")), labels)
    model = ratio_model(rows, backing)
    scalar = lambda c: model.select(c).scalar().alias(c)
    names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    grams = base_counts(rows).select(*names, "trusted", n_grams("hashes").alias("all_grams")).select(
        *names, "trusted", F.when(F.col("trusted"), F.sort_array("all_grams")).otherwise(F.col("all_grams")).alias("grams")
    )
    place = lambda x, i: F.when((i == 0) | (F.get(F.col("grams"), i - 1) != x), i)
    firsts = F.when(F.col("trusted"), F.filter(F.transform("grams", place), lambda i: i.isNotNull())).alias("firsts")
    counted = grams.select(*names, "grams", firsts)
    # What a generator makes is computed once and stays a column: without it, a filter on the verdict would be pushed
    # below the counts and written out inside the lambdas. A subquery may not be written inside a lambda, but the optimizer
    # folds a column that is read once into it, so that the arrays are never copied into a row (tests look at the plan).
    once = counted.select(F.explode_outer(F.array(F.struct(*counted.columns))).alias("c")).select("c.*")
    ratio = _ratio_sum("target", "scale", "weights", F.col("all_target"), backing) / F.greatest(F.size("grams"), F.lit(1))
    mean = F.get(F.col("means"), language_bucket(F.col("row.lang")))
    scored = (
        once.select(*names, "grams", "firsts", *[scalar(c) for c in ("weights", "target", "scale", "all_target", "means")])
        .select(*names, failed.alias("base_failed"), F.when(F.size("grams") > 0, ratio - mean).otherwise(0.0).alias("ratio"))
    )
    return scored.select(*names, "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    return quality_verdicts(docs, labels, threshold).where("kept").select("row.*")
