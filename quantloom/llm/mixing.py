"""Mixing sources to target weights: temperature mixing on built-in functions only.

A source with n tokens gets a weight in proportion to n ** alpha. The exponent is bisected inside one expression over
the array of source totals (one number for each source) until the mixture meets a limit on repetition or a target
entropy. The budget of tokens defaults to the smallest at which no source is cut: the source that the weights favour
least is read exactly once, the others repeat. A given budget may also cut sources.

Realisation: budget x weight gives each source a target in tokens. Its documents are dealt into blocks of about
`block_tokens` by a hash of (seed, id), which permutes them. The target is filled with whole passes first; the rest
takes blocks in their order while they fit, and from the block that the target cuts, the documents of its own
permutation while they fit. Only block totals are summed up along a source; documents are summed up inside one
block, so a source that holds most of the corpus is spread over as many tasks as it has blocks.

Defined cases: a NULL source is a source of its own; NULL or empty texts have no tokens and take part in whole passes
only; a source without any token is read once; equal hashes are ordered by id and text; repeated rows are separate
documents; an empty table gives no rows; all columns of the input travel in a struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.text import packed, whole

STEPS = 50
BLOCK_TOKENS = 1_000_000


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, n: acc + f(n))


def _repetition(totals: Column, alpha: Column, budget: Column | None) -> Column:
    """Passes over the most repeated source."""
    most = F.array_max(F.transform(totals, lambda n: F.pow(n, alpha - 1)))
    if budget is None:
        return most / F.array_min(F.transform(totals, lambda n: F.pow(n, alpha - 1)))
    return budget * most / _total(totals, lambda n: F.pow(n, alpha))


def _entropy(totals: Column, alpha: Column) -> Column:
    scale = _total(totals, lambda n: F.pow(n, alpha))
    return _total(totals, lambda n: -(F.pow(n, alpha) / scale) * F.ln(F.pow(n, alpha) / scale))


def exponent(
    totals: Column, repeat_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None
) -> Column:
    """The smallest exponent in 0..1 that keeps the limit, or that in 0..8 whose entropy is the target's.

    1 where even the natural shares repeat more than the limit; 0 or 8 where the entropy is out of reach.
    """
    if (repeat_limit is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    top = 1.0 if target_entropy is None else 8.0

    def enough(alpha: Column) -> Column:
        if target_entropy is None:
            return _repetition(totals, alpha, None if budget is None else F.lit(float(budget))) <= repeat_limit
        return _entropy(totals, alpha) <= target_entropy

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = enough(mid)
        return F.struct(
            F.when(low, acc["lo"]).otherwise(mid).alias("lo"), F.when(low, mid).otherwise(acc["hi"]).alias("hi")
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"]
    return F.round(F.when(enough(F.lit(0.0)), 0.0).otherwise(found), 9)


def source_targets(
    sized: DataFrame, repeat_limit: float | None, target_entropy: float | None, budget: int | None
) -> DataFrame:
    """Per source of (source, n_tokens): total, alpha, weight, target tokens, whole passes and what is left over."""
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    totals = F.collect_list(F.when(F.col("total") > 0, F.col("total").cast("double")))
    whole_mix = per_source.agg(F.sort_array(totals).alias("totals"))
    whole_mix = whole_mix.select("totals", exponent(F.col("totals"), repeat_limit, target_entropy, budget).alias("alpha"))
    whole_mix = whole_mix.select(
        "alpha",
        _total(F.col("totals"), lambda n: F.pow(n, F.col("alpha"))).alias("scale"),
        F.array_min(F.transform("totals", lambda n: F.pow(n, F.col("alpha") - 1))).alias("least"),
    )
    n = F.col("total").cast("double")
    share = F.pow(n, F.col("alpha"))
    wanted = share / F.col("least") if budget is None else F.lit(float(budget)) * share / F.col("scale")
    has = F.col("total") > 0
    return (
        per_source.crossJoin(F.broadcast(whole_mix))
        .select(
            "source",
            "total",
            F.when(has, F.col("alpha")).alias("alpha"),
            F.when(has, share / F.col("scale")).otherwise(0.0).alias("weight"),
            F.when(has, F.round(wanted).cast("long")).otherwise(0).alias("target"),
        )
        .withColumn("passes", F.when(has, F.expr("target div total")).otherwise(1))
        .withColumn("rest", F.when(has, F.col("target") - F.col("passes") * F.col("total")).otherwise(0))
    )


def copies_of_each(
    docs: DataFrame,
    repeat_limit: float | None = None,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """`row` (all columns of docs), source, n_tokens, alpha, weight, block, and copies: how often the mixture has it."""
    # Eight hexadecimal digits of MD5: the same permutation in every engine.
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        packed(docs.columns, "row"),
        "source",
        F.col("doc_id").alias("id"),
        F.regexp_count(whole(F.col("text")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        F.conv(F.substring(draw, 1, 8), 16, 10).cast("long").alias("draw"),
        F.substring(draw, 9, 8).alias("order"),
    )
    targets = source_targets(sized, repeat_limit, target_entropy, budget)
    blocks = F.greatest(F.ceil(F.col("total") / block_tokens), F.lit(1))
    # One row for each source on the broadcast side; the optimizer checks its size and shuffles it otherwise.
    dealt = (
        sized.alias("d")
        .join(targets.alias("t"), F.expr("d.source <=> t.source"))
        .select("row", "d.source", "id", "n_tokens", "order", "alpha", "weight", "passes", "rest", F.pmod("draw", blocks).alias("block"))
    )
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source", "block")
        .agg(F.sum("n_tokens").alias("block_total"))
        .select("source", "block", F.coalesce(F.sum("block_total").over(along), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("d.source", "d.block").orderBy("order", "id", "n_tokens")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.col("start") + F.sum("n_tokens").over(inside) <= F.col("rest")
    return (
        dealt.alias("d")
        .join(starts.alias("s"), F.expr("d.source <=> s.source AND d.block = s.block"))
        .select(
            "row",
            "d.source",
            "n_tokens",
            "alpha",
            "weight",
            "d.block",
            (F.col("passes") + ((F.col("n_tokens") > 0) & fits).cast("long")).alias("copies"),
        )
    )


def mixed(docs: DataFrame, **limits) -> DataFrame:
    """The mixture: each document as often as it has copies, with all columns of `docs`."""
    counted = copies_of_each(docs, **limits).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
