"""Span algebra with higher-order functions: spans are STRUCT<start, end>, half open, from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"


def span(start: Column | int, end: Column | int) -> Column:
    return F.struct(F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end")) if not isinstance(start, Column) else F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def merge_spans(spans: Column) -> Column:
    """Touching and overlapping spans as one, in order (a fold over the sorted array)."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grow = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= last["end"], grow).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans.cast(SPANS)), F.array().cast(SPANS), step)


def merge_span_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merged spans of rows (gaps and islands): one window by key, then a partial aggregate by key and island."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def shift(spans: Column, by: Column | int) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).cast("int").alias("start"), (s["end"] + by).cast("int").alias("end")))


def distance(a: Column, b: Column) -> Column:
    """Characters between two spans; negative where they overlap."""
    return F.greatest(a["start"] - b["end"], b["start"] - a["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def touches_any(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: overlaps(s, o))


def without_overlaps(spans: Column, others: Column) -> Column:
    """``spans`` that overlap none of ``others`` (an interval anti-join within a row)."""
    return F.filter(spans, lambda s: ~touches_any(s, others))


def inside(spans: Column, outer: Column) -> Column:
    """``spans`` that lie fully inside the span ``outer``."""
    return F.filter(spans, lambda s: (s["start"] >= outer["start"]) & (s["end"] <= outer["end"]))


def clip(spans: Column, others: Column) -> Column:
    """Parts of ``spans`` outside ``others``: inner ones are dropped, partly covered ones cut to the longer free side."""

    def cut(s: Column, o: Column) -> Column:
        left, right = o["start"] - s["start"], s["end"] - o["end"]
        keep_left = F.struct(s["start"].alias("start"), o["start"].alias("end"))
        keep_right = F.struct(o["end"].alias("start"), s["end"].alias("end"))
        return F.when(~overlaps(s, o), s).when((left <= 0) & (right <= 0), F.lit(None)).when(left >= right, keep_left).otherwise(keep_right)

    cut_all = F.transform(spans, lambda s: F.aggregate(others, s, lambda acc, o: F.when(acc.isNull(), acc).otherwise(cut(acc, o))))
    return F.filter(cut_all, lambda s: s.isNotNull())


def envelope(spans: Column) -> Column:
    return F.struct(F.array_min(F.transform(spans, lambda s: s["start"])).alias("start"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("end"))


def unique_nearest(spans: Column, target: Column, below: int = 2) -> Column:
    """The span nearest to ``target`` if it alone is so near and closer than ``below``; else null."""
    gaps = F.transform(spans, lambda s: distance(s, target))
    least = F.array_min(gaps)
    best = F.filter(spans, lambda s: distance(s, target) == least)
    return F.when((F.size(best) == 1) & (least < below), F.get(best, F.lit(0)))


def substring(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def blank_out(text: Column, spans: Column) -> Column:
    """The text with spaces, one for each character, in place of spans."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def right_to_left(spans: Column) -> Column:
    """Spans by their end, last first, for editing a text without moving what is still to be edited."""
    return F.reverse(F.array_sort(spans, lambda a, b: F.when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(a["start"] - b["start"])))


def mark(text: Column, spans: Column, tag: str) -> Column:
    """The text with ``tag`` before and after each span."""
    return F.aggregate(right_to_left(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(tag), substring(t, s), F.lit(tag), F.substring(t, s["end"] + 1, F.length(t))))


def token_to_char(tokens: Column, first: Column, last: Column) -> Column:
    """The character span of tokens ``first`` to ``last`` (from 0, inclusive)."""
    return F.struct(F.get(tokens, first)["start"].alias("start"), F.get(tokens, last)["end"].alias("end"))


def trimmed(text: Column, s: Column) -> Column:
    """The span without white space before and without spaces and periods after its text."""
    body = substring(text, s)
    lead = F.length(body) - F.length(F.regexp_replace(body, r"^\s+", ""))
    tail = F.length(body) - F.length(F.regexp_replace(body, r"[ .]+$", ""))
    return F.struct((s["start"] + lead).cast("int").alias("start"), (s["end"] - tail).cast("int").alias("end"))


def count_spans(annotations: Column) -> Column:
    """The number of spans in a map of tags to spans."""
    return F.aggregate(F.map_values(annotations), F.lit(0), lambda n, spans: n + F.size(spans))


def pruned(annotations: Column) -> Column:
    """A map of tags to spans without empty tags."""
    return F.map_filter(annotations, lambda tag, spans: F.size(spans) > 0)
