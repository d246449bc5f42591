"""Quality classifier: a sparse rule ensemble over document statistics.

Statistics of every whole text are computed by built-in functions and stored once (ids and numbers only). Shallow
trees are grown on labelled rows; each path from a root to a node becomes a rule, a conjunction of comparisons; a
lasso-penalised logistic regression over the rules keeps few of them. The rules that are left are compiled into one
Spark column expression, so scoring needs no Python and no model file.

Only the fit is bounded: it takes at most `FIT_ROWS` labelled rows, those with the smallest hashes of their ids, and
never a held-out row. All documents are measured and scored. labels, lang, source and doc_id are no inputs of a score.

Defined cases: NULL and empty texts have statistics 0 and get a score; repeated labels of a document count as their
largest, NULL labels are ignored; without any usable label each score is 0.5; with labels of one kind only it is the
smoothed share of that kind; rows with a NULL id aren't held out and are scored; repeated rows score alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.text import GAP, whole, words
from quantloom.storage import materialise

#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000
TREES, DEPTH = 12, 3
PENALTY = 0.002

STATISTICS = [
    "n_words", "word_length", "symbols", "capitals", "digits", "marks", "distinct_words", "repeated_lines", "line_words", "longest_word",
]

#: (statistic, below or equal, bound); a rule is a sorted tuple of these.
Condition = tuple[str, bool, float]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS (doubles, never NULL) of every document."""
    text = whole(F.col("text"))
    counted = docs.select(
        "doc_id",
        words(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, GAP, "")).alias("chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("digits"),
        F.regexp_count(text, F.lit(r"[!?]")).alias("marks"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, chars = F.size("words"), F.col("chars")
    return counted.select(
        "doc_id",
        n.cast("double").alias("n_words"),
        share(chars, n).alias("word_length"),
        share(F.col("symbols"), n).alias("symbols"),
        share(F.col("capitals"), chars).alias("capitals"),
        share(F.col("digits"), chars).alias("digits"),
        share(F.col("marks"), n).alias("marks"),
        share(F.size(F.array_distinct("words")), n).alias("distinct_words"),
        share(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")).alias("repeated_lines"),
        share(n, F.size("lines")).alias("line_words"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double").alias("longest_word"),
    )


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)")


def tree_rules(debug_text: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """The path to each node but the roots as a rule, from the printed form of a tree ensemble."""
    rules = set()
    path: list[tuple[int, Condition]] = []
    for line in debug_text.splitlines():
        found = _LINE.match(line)
        if not found:
            if line.strip().startswith("Tree "):
                path = []
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[3])], found[4] == "<=", float(found[5])))]
        rules.add(_simplified([c for _, c in path]))
    return rules


def _simplified(path: list[Condition]) -> tuple[Condition, ...]:
    """Of several bounds on the same side of a statistic only the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, below, bound in path:
        now = tight.get((name, below), bound)
        tight[(name, below)] = min(now, bound) if below else max(now, bound)
    return tuple(sorted((name, below, bound) for (name, below), bound in tight.items()))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    return reduce(and_, [F.col(n) <= b if below else F.col(n) > b for n, below, b in rule])


def fit_rules(
    labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY
) -> tuple[float, dict[tuple[Condition, ...], float]]:
    """Intercept and the weights of the rules that the penalty leaves, from STATISTICS and `label` (0.0 or 1.0)."""
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8).fit(assembled)
    rules = sorted(tree_rules(forest.toDebugString, STATISTICS))
    if not rules:
        rate = labelled.agg(F.avg("label")).first()[0]
        return math.log(rate / (1 - rate)), {}
    fired = labelled.select(
        "label", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features")
    )
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(materialise(fired, "rules"))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients, strict=True) if w}
    return float(model.intercept), weights


def score_column(intercept: float, weights: dict[tuple[Condition, ...], float]) -> Column:
    """The ensemble as one expression over STATISTICS."""
    total = F.lit(intercept)
    for rule, weight in weights.items():
        total = total + F.when(rule_column(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted."""
    measured = materialise(statistics(docs), "statistics")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    known = known.agg((F.max("quality") == 1).cast("double").alias("label"))
    usable = measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    sample = materialise(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit-rows")
    kinds = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        n = sum(kinds.values())
        score = F.lit((kinds.get(1.0, 0) + 1) / (n + 2))
    else:
        score = score_column(*fit_rules(sample))
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
