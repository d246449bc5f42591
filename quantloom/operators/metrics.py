"""Evaluation of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import ratio
from quantloom.operators.order import running_totals


def class_shares(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows and share of every class."""
    total = df.agg(F.count(label).alias("_total"))
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("rows"))
        .crossJoin(F.broadcast(total))
        .select(label, "rows", (F.col("rows") / F.col("_total")).alias("share"))
    )


def classification_report(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    The four confusion counts come from one aggregate row; a measure without cases is 0.
    """
    cells = {f"c{t}{p}": (F.col(label) == t) & (F.col(prediction) == p) for t in (0, 1) for p in (0, 1)}
    counts = df.agg(*[F.count_if(when).cast("double").alias(name) for name, when in cells.items()])

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(ratio(part, whole), F.lit(0.0))

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    c = {name: F.col(name) for name in cells}
    hit = [c["c00"], c["c11"]]
    said = [c["c00"] + c["c10"], c["c01"] + c["c11"]]
    true = [c["c00"] + c["c01"], c["c10"] + c["c11"]]
    precision = [share(hit[i], said[i]) for i in (0, 1)]
    recall = [share(hit[i], true[i]) for i in (0, 1)]
    f1 = [share(2 * hit[i], said[i] + true[i]) for i in (0, 1)]
    rows = true[0] + true[1]
    accuracy = share(hit[0] + hit[1], rows)

    def macro(values: list[Column]) -> Column:
        return (values[0] + values[1]) / 2

    def weighted(values: list[Column]) -> Column:
        return share(values[0] * true[0] + values[1] * true[1], rows)

    lines = F.array(
        *[line(str(i), precision[i], recall[i], f1[i], true[i]) for i in (0, 1)],
        line("accuracy", accuracy, accuracy, accuracy, rows),
        *[
            line(name, average(precision), average(recall), average(f1), rows)
            for name, average in (("macro avg", macro), ("weighted avg", weighted))
        ],
    )
    return counts.select(F.explode(lines).alias("line")).select("line.*")


def roc_areas(df: DataFrame, by: Sequence[str], label: str = "target", score: str = "score") -> DataFrame:
    """Exact area under the curve of each group, ties at their average rank: (by.., positives, negatives, auc).

    One pass for all groups. Rows are counted by group and score first: an area needs each score's positives and
    negatives and the negatives below it, never the ranks of rows. A group with one class has no area (NULL).
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    up = F.col(label) == 1
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    counted = known.groupBy(group.alias("group"), F.col(score).cast("double").alias("score")).agg(
        F.count_if(up).alias("up"), F.count_if(~up).alias("down")
    )
    totals = running_totals(counted, "group", "score", ["down"])
    won = F.sum(F.col("up").cast("double") * (F.col("down_before") + F.col("down") / 2.0))
    sums = [won.alias("won"), F.sum("up").alias("positives"), F.sum("down").alias("negatives")]
    found = totals.groupBy("group").agg(*sums) if by else totals.agg(*sums).withColumn("group", F.lit(0))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return found.select(*[F.col(f"group.{c}").alias(c) for c in by], "positives", "negatives", ratio(F.col("won"), p * n).alias("auc"))


def roc_auc(df: DataFrame, label: str = "target", score: str = "score") -> DataFrame:
    """One row (positives, negatives, auc) over all rows."""
    return roc_areas(df, [], label, score)
