"""Statistics of the datasets: counts of reasons, pages and examples, summed over parts and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quantspark.operators import filters


def total(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """The number of rows as a counter."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(dataset).alias("dataset"), F.lit("counts").alias("category"), F.lit(key).alias("key"), "n")


def dataset_statistics(pages: DataFrame, examples: dict[str, DataFrame]) -> DataFrame:
    """(dataset, category, key, n) for ``examples`` (with drop_reason, perhaps weak_accept_reasons) of each dataset: one table of counters, merged by sums."""
    parts = []
    for name, found in examples.items():
        kept = found.where("drop_reason IS NULL")
        parts += [total(pages, name, "analyzed_pages"), total(found, name, "candidates"), total(kept, name, "number_of_examples")]
        parts.append(filters.reason_counts(found, name, "dropped_cause", "drop_reason"))
        if "weak_accept_reasons" in found.columns:
            parts.append(filters.reason_counts(kept.select(F.explode("weak_accept_reasons").alias("why")), name, "accept_cause", "why"))
    return filters.merged_counts(*parts)


def _counters(columns: list[str]) -> dict[tuple[str, str], Column]:
    """(category, key): the aggregate of each counter; reasons that aren't known are counted together."""
    reason, used = F.col("drop_reason"), F.col("drop_reason").isNull()
    out = {("counts", "candidates"): F.count(F.lit(1)), ("counts", "number_of_examples"): F.count_if(used)}
    known = list(dict.fromkeys([*filters.OF_SENTENCES, *filters.DROPPED]))
    out |= {("dropped_cause", r): F.count_if(reason == r) for r in known}
    out["dropped_cause", "other"] = F.count_if(reason.isNotNull() & ~reason.isin(known))
    if "weak_accept_reasons" in columns:
        doubts = [*filters.WEAK, "choose_single_annotation_based_on_parentheses"]
        out |= {("accept_cause", w): F.count_if(used & F.array_contains("weak_accept_reasons", w)) for w in doubts}
    return out


class Observed:
    """Counters of a job, taken by the pass that makes its examples.

    ``pages`` and ``examples`` give the frames to go on with; ``table`` has the counters once an action has run on both.
    """

    def __init__(self, dataset: str):
        self.dataset, self._pages, self._examples, self._names = dataset, Observation(), Observation(), []

    def pages(self, df: DataFrame) -> DataFrame:
        self._spark = df.sparkSession
        return df.observe(self._pages, F.count(F.lit(1)).alias("n"))

    def examples(self, df: DataFrame) -> DataFrame:
        counters = _counters(df.columns)
        self._names = list(counters)
        return df.observe(self._examples, *[c.alias(f"c{k}") for k, c in enumerate(counters.values())])

    def table(self) -> DataFrame:
        got = self._examples.get
        rows = [("counts", "analyzed_pages", self._pages.get["n"]), *[(*name, got[f"c{k}"]) for k, name in enumerate(self._names)]]
        shown = [(self.dataset, category, key, n) for category, key, n in rows if n or category == "counts"]
        return self._spark.createDataFrame(shown, "dataset string, category string, key string, n long")


def merged(*statistics: DataFrame) -> DataFrame:
    """Statistics of several runs as one: counters of equal names are added up."""
    return filters.merged_counts(reduce(lambda a, b: a.unionByName(b), statistics))


def reduction(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """How many rows an operator was given and how many it kept, as counters."""
    return total(before, name, "before").unionByName(total(after, name, "after"))
