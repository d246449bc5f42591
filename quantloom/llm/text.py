"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, or an empty one where it is NULL."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """All words of the text in order."""
    return F.array_remove(F.split(whole(text), GAP), "")


def one_spaced(text: Column) -> Column:
    """The text with each run of white space replaced by one blank."""
    return F.regexp_replace(whole(text), GAP, " ")


def packed(columns: list[str], name: str = "packed") -> Column:
    """All columns in one struct, so that an operator's own columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)
