"""Interval joins and ranks of whole tables against plain Python, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from quantspark.operators import frequency, intervals, ranks, statements
from quantspark.plans import catalogue_orders

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def intervals_of(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.randrange(-300, 3000)
        out.append((i, r.choice(["hot", "hot", "a", None]), start, start + r.choice([0, 1, 5, 16, 17, 64, 500, 4000])))
    return [*out, (n, "hot", None, 5), (n + 1, "hot", 5, None)]


@pytest.mark.parametrize("seed", range(3))
def test_pairs(spark, seed):
    left, right = intervals_of(seed, 120), intervals_of(seed + 50, 90)
    names = "id long, k string, start long, end long"
    dfs = [spark.createDataFrame(x, names) for x in (left, right)]
    full = lambda rows: [r for r in rows if None not in r]
    overlap = sorted((x[0], y[0]) for x in full(left) for y in full(right) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    inside = sorted((x[0], y[0]) for x in full(left) for y in full(right) if x[1] == y[1] and x[2] >= y[2] and x[3] <= y[3])
    ids = lambda df: sorted((r.left.id, r.right.id) for r in df.collect())
    assert ids(intervals.pairs(*dfs, ["k"])) == overlap
    assert ids(intervals.pairs(*dfs, ["k"], inside=True)) == inside
    free = {x[0] for x in left} - {a for a, _ in overlap}
    assert {r.id for r in intervals.without_overlaps(*dfs, ["k"], ["id"]).collect()} == free


def test_empty_sides(spark):
    names = "id long, k string, start long, end long"
    some, none = spark.createDataFrame([(1, "a", 0, 5)], names), spark.createDataFrame([], names)
    assert intervals.pairs(some, none, ["k"]).count() == intervals.pairs(none, some, ["k"]).count() == 0
    assert intervals.without_overlaps(some, none, ["k"], ["id"]).count() == intervals.clipped(some, none, ["k"], ["id"]).count() == 1


def test_hot_user_is_split(spark):
    left, right = catalogue_orders.event_intervals(spark, SF)
    found = intervals.pairs(left, right, ["k"])
    a = intervals._listed(left, "left", ["k"], intervals._levels(left), intervals._levels(right))
    b = intervals._listed(right, "right", ["k"], intervals._levels(right), intervals._levels(left))
    cells = ["__k", "__level", "__meets", "__cell"]
    met = a.groupBy(*cells).agg(F.count(F.lit(1)).alias("x")).join(b.groupBy(*cells).agg(F.count(F.lit(1)).alias("y")), cells)
    compared = met.agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    quadratic = left.groupBy("k").count().join(right.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "k").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert compared < quadratic / 10 and compared < 8 * found.count()


def test_ranks_and_their_plans(spark):
    r = random.Random(3)
    rows = [(r.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, qid long").repartition(7)
    ranked = frequency.ranked(df)
    want = {q: k + 1 for k, (n, q) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert {x.qid: x.rank for x in ranked.collect()} == want
    for out in (ranked, statements.chunked(df, "qid", size=7), ranks.between(df, "qid", offset=5, limit=90)):
        text = plan(out)
        assert "Window" not in text and "GlobalLimit" not in text and "Offset" not in text
    assert sorted(x.qid for x in ranks.between(df, "qid", offset=5, limit=90).collect()) == list(range(5, 95))
    assert sorted(x.qid for x in ranks.between(df, "qid", offset=390).collect()) == list(range(390, 400))
    assert ranks.between(df, "qid", offset=400, limit=3).count() == 0 and ranks.between(df, "qid").count() == 400


def test_ties_across_a_page(spark):
    df = spark.createDataFrame([(i // 10, i) for i in range(100)], "k long, i long").repartition(5)
    assert sorted(x.i for x in ranks.between(df, "k", "i", offset=14, limit=31).collect()) == list(range(14, 45))
    assert ranks.numbered(df.limit(0), "k").count() == 0


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)], "k long").repartition(4)
    assert sorted(x.rank for x in ranks.numbered(df, "k").collect()) == list(range(1, 52))
