"""Connected components of a large edge table by alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour, then its smaller ones, until nothing moves;
the rounds grow with the logarithm of a component's width. Minima are combined before the shuffle, the join back to a
node with very many neighbours is left to adaptive skew handling (the other side has one row for each node), and each
round is written to the shared folder, so a lost executor never replays the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.storage import discard, materialise


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (u, v) but the smallest of each component."""
    state = None
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        last, state = state, now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        following = materialise(_round(now), "edges")
        discard(now)
        now = following
