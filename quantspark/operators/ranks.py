"""Ranks over a whole table without one task that sees all rows: range partitions and counts of what lies before each."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.sources.tables import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 1) -> DataFrame:
    """``df`` with the place of each row in ``order`` as ``name``, from ``start`` on.

    Rows are sorted into ranges, which many tasks hold; only a count for each range reaches the driver. Rows that are
    equal in ``order`` get places one after another, so an order that tells all rows apart makes reruns agree. A range
    holds all rows that are equal in ``order``.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # Kept, so that the places that are counted are those that are joined.
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((r.n for r in counts), initial=start)
    shifts = df.sparkSession.createDataFrame([(r.part, b - (r.part << 33)) for r, b in zip(counts, before, strict=False)], "__part long, __shift long")
    joined = placed.join(F.broadcast(shifts), part == F.col("__part"))
    return joined.select(*df.columns, (F.col("__place") + F.col("__shift")).alias(name))


def between(df: DataFrame, *order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows of ``df`` from ``offset`` on in ``order``, at most ``limit``; in as many tasks as they need.

    The first column of ``order`` alone is ranked to find the values between which the rows lie; only these rows are
    then ordered as a whole. Rows in which it is null don't count.
    """
    if not offset and limit is None:
        return df
    first, until = order[0], (1 << 62) if limit is None else offset + limit
    known = df.where(F.col(first).isNotNull())
    ids = numbered(known.select(first), first, name="__nth", start=0)
    place = F.col("__nth")
    low, high = ids.where((place >= offset) & (place < until)).agg(F.min(first), F.max(first)).first()
    if low is None:
        return known.limit(0)
    before = ids.where(F.col(first) < low).count()
    some = known.where(F.col(first).between(low, high))
    return numbered(some, *order, name="__nth", start=before).where((place >= offset) & (place < until)).drop("__nth")
