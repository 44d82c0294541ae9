"""Dates with precision: parsing, precision codes, equality at the coarser precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ["year", "month", "day", "hour", "minute", "second"]
#: Knowledge-graph codes of time precision (fixed values).
PRECISION_CODES = {0: "year", 1: "year", 3: "year", 4: "year", 5: "year", 6: "year", 7: "year", 8: "year", 9: "year", 10: "month", 11: "day", 12: "hour", 13: "minute", 14: "second"}
#: Formats of dates in text with the precision that they give; a year is always needed.
FORMATS = [
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy-MM-dd", "day"), ("MMMM d, yyyy", "day"), ("d MMMM yyyy", "day"),
    ("MMM d, yyyy", "day"), ("d MMM yyyy", "day"), ("MM/dd/yyyy", "day"), ("dd.MM.yyyy", "day"), ("MMMM yyyy", "month"), ("MMM yyyy", "month"), ("yyyy-MM", "month"), ("yyyy", "year"),
]


def precision_of(code: Column) -> Column:
    """The precision that a code names; null for unknown codes."""
    table = F.create_map(*[F.lit(x) for pair in PRECISION_CODES.items() for x in pair])
    return F.try_element_at(table, code.try_cast("int"))


def parse_date(text: Column) -> Column:
    """STRUCT<at, precision> of an absolute English date, else null."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\b(of|the)\b ?", "")

    def first(c: Column) -> Column:
        tries = []
        for pattern, precision in FORMATS:
            at = F.try_to_timestamp(c, F.lit(pattern))
            tries.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(precision).alias("precision"))))
        return F.coalesce(*tries)

    # As a lambda, so that the cleaned text is made once and not for each format.
    return F.get(F.transform(F.array(cleaned), first), F.lit(0))


def parse_known(text: Column) -> Column:
    """The time of a knowledge-graph literal; ``+`` in front and month or day ``00`` are read as their first."""
    bare = F.regexp_replace(text, r"^\+", "")
    bare = F.regexp_replace(bare, r"^(\d{4})-00", "$1-01")
    bare = F.regexp_replace(bare, r"^(\d{4}-\d{2})-00", "$1-01")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))


def same_date(known: Column, known_precision: Column, stated: Column, stated_precision: Column) -> Column:
    """Whether two times agree down to the coarser of their precisions; false where either is missing."""
    rank = lambda p: F.array_position(F.array(*[F.lit(x) for x in PRECISIONS]), p)
    least = F.least(rank(known_precision), rank(stated_precision))
    equal = F.lit(False)
    for k, precision in enumerate(PRECISIONS, 1):
        equal = F.when(least == k, F.date_trunc(precision, known) == F.date_trunc(precision, stated)).otherwise(equal)
    return F.coalesce(equal, F.lit(False))
