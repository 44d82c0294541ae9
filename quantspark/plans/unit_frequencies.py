"""Frequencies of units of measure in a corpus, over full texts or over quantities alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators import frequency

MODES = ("full_text", "quantities")


def texts_of(pages: DataFrame, mode: str, limit: int | None = None) -> DataFrame:
    """(id, text) of the pages that a mode analyses: all of them, or the first ``limit`` by id."""
    some = frequency.pages_to_analyse(pages, limit, quantities_only=mode == "quantities")
    if mode == "full_text":
        return some.select("id", F.array_join(F.transform("text", lambda p: F.array_join(p, " ")), " ").alias("text"))
    sides = F.transform("quantities", lambda q: F.coalesce(F.get(q, F.lit(2)), F.lit("")))
    return some.select("id", F.array_join(sides, " ; ").alias("text"))


def units_of(facts: DataFrame, conversions: DataFrame) -> DataFrame:
    """(qid): the distinct units of facts and those that they convert to."""
    return facts.select(F.col("unit").alias("qid")).union(conversions.select("to_unit")).where("qid IS NOT NULL").distinct()


def count(pages: DataFrame, facts: DataFrame, conversions: DataFrame, labels: DataFrame, stop: DataFrame, modes: tuple[str, ...] = MODES, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mode, qid, n) of all units of facts and what they convert to, and (mode, qid) of those without a label."""
    units = units_of(facts, conversions)
    counted, nameless = [], []
    for mode in modes:
        found = frequency.unit_frequencies(texts_of(pages, mode, (limits or {}).get(mode)), ["id"], units, labels, stop)
        counted.append(found.select(F.lit(mode).alias("mode"), "qid", "n"))
        nameless.append(frequency.unlabelled(units, labels).select(F.lit(mode).alias("mode"), "qid"))
    out, without = counted[0], nameless[0]
    for a, b in zip(counted[1:], nameless[1:], strict=True):
        out, without = out.unionByName(a), without.unionByName(b)
    return out, without
