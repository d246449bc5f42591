"""Bit maps of a fixed size that mark 64-bit hashes: a broadcast with a proven bound, whatever the corpus is.

A map says `maybe` for every hash that it was built from and for few others; what it marks is checked exactly afterwards,
what it doesn't mark needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.storage import materialise

#: Bits of a map: 2,048 rows of 4 KB. Two hashes on one bit only cost work.
MARKS = 1 << 26


def _bit(hashed: Column) -> Column:
    return (F.pmod(hashed, F.lit(MARKS)) + 1).cast("long")


def marks_of(hashes: DataFrame, column: str) -> DataFrame:
    """(at, map): the stored map of a column of hashes."""
    bits = hashes.select(_bit(F.col(column)).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    return materialise(maps, "marks")


def with_mark(rows: DataFrame, hashed: Column, marks: DataFrame) -> DataFrame:
    """Add `marked`: whether the row's hash is on the map (never for a NULL hash)."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    place = "int(bitmap_bit_position(_bit))"
    byte = f"int(conv(hex(substring(map, int({place} div 8) + 1, 1)), 16, 10))"
    placed = rows.withColumn("_bit", _bit(hashed)).withColumn("at", F.bitmap_bucket_number("_bit"))
    marked = F.expr(f"coalesce(shiftright({byte}, {place} % 8) % 2 = 1, false)")
    return placed.join(F.broadcast(marks), "at", "left").select(*kept, marked.alias("marked"))
