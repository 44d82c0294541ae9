"""Ordered operators: running offsets, paragraphs, neighbours, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(df: DataFrame, keys: list[str], order: list[str], size: Column, name: str = "offset") -> DataFrame:
    """The sum of ``size`` over earlier rows of a key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def offsets_in(texts: Column) -> Column:
    """Within a row: where each entry of an array of texts starts in their concatenation."""
    return F.transform(F.sequence(F.lit(1), F.size(texts)), lambda i: F.aggregate(F.slice(texts, F.lit(1), i - 1), F.lit(0), lambda n, t: n + F.length(t)))


def paragraphs(df: DataFrame, keys: list[str], order: list[str], is_break: Column) -> DataFrame:
    """The number of breaks up to each row: its paragraph."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("par_idx", F.sum(F.when(is_break, 1).otherwise(0)).over(upto).cast("int"))


def with_context(df: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """All texts before and after each row within its key; their size grows with the square of a key's rows."""
    by = Window.partitionBy(*keys).orderBy(*order)
    before = F.collect_list(text).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.collect_list(text).over(by.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({"before": before, "after": after})


def with_previous(df: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    return df.withColumn("previous", F.lag(text).over(Window.partitionBy(*keys).orderBy(*order)))


def with_bounds(df: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """The end of the last span and the start of the next one: how far a span may grow; equal spans are ordered by ``ties``."""
    by = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    return df.withColumns({"last_end": F.lag("end").over(by), "next_start": F.lead("start").over(by)})


def segments(text: Column, separator: str) -> Column:
    """Array of STRUCT<start, end> of what lies between separators."""
    parts = F.split(text, separator)
    gap = len(separator.replace("\\", ""))

    def step(acc: Column, part: Column) -> Column:
        start = F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)["end"] + gap)
        return F.concat(acc, F.array(F.struct(start.cast("int").alias("start"), (start + F.length(part)).cast("int").alias("end"))))

    return F.aggregate(parts, F.array().cast("array<struct<start:int,end:int>>"), step)


def segment_of(text: Column, at: Column, separator: str) -> Column:
    """The segment that holds the character ``at``."""
    return F.get(F.filter(segments(text, separator), lambda s: (s["start"] <= at) & (at < s["end"])), F.lit(0))
