"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

A source's target is its weight's share of all tokens, but at most ``MAX_REPEAT`` times its own tokens; what a
source can't take is shared again by weight until no target is above its limit. Targets are apportioned twice in
blocks of ``BLOCK`` tokens: over sources, then, for each source, over shards of its documents. Blocks go to the
highest quotients ``v / (2 s + 1)``; only the few blocks near the cut are ever listed as rows (about as many as there
are sources, or shards of a source), the sure ones below it are counted in closed form.

Within a shard the documents of a source lie on a line of tokens in seeded order. A quota first takes the whole line
as often as it holds it, then a run of blocks from a seeded place on, round the end. So each document's tokens taken
follow from where it lies on the line: one window function over a cell (source, shard) of bounded size, as the number
of shards grows with the rows. A hot source has as many cells as any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark.llm.store import cut

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 16
#: A shard has so many rows at least, and with the root of the number of rows more, so that neither cells nor the
#: number of shards that a source's blocks are apportioned to gets large.
LEAST_ROWS_PER_SHARD, ROOTS_PER_SHARD = 2_000, 10
MAX_BROADCAST_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, *values: Column) -> Column:
    """A number of 60 bits from MD5 of the seed and values, which any engine can compute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, weight, target for each source of ``sizes`` (source, size).

    Sources by code point, null last, have ``weights`` in turn. With sources in the order of limit over weight, those
    that stop at their limit come first; the rest share what is left by weight. One task orders the sources: a row of
    four numbers for each, so a million sources are a few dozen megabytes; documents are never ordered as a whole.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    listed = per_source.withColumn("weight", F.element_at(cycle, (rank + 1).cast("int")))
    limit = max_repeat * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    total, stopped = F.sum("source_size").over(whole), F.coalesce(F.sum(limit).over(before), F.lit(0))
    level = (total - stopped) / F.sum("weight").over(from_here)
    listed = listed.withColumns({"level": level, "limit": limit})
    free = F.col("level") * F.col("weight") <= F.col("limit")
    settled = listed.withColumns({"free": free, "common": F.max(F.when(free, F.col("level"))).over(whole)})
    target = F.when(F.col("free"), F.col("common") * F.col("weight")).otherwise(F.col("limit"))
    return settled.select("source", "source_size", "weight", F.coalesce(target, F.lit(0)).cast("double").alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], value: str, seats: str) -> DataFrame:
    """``votes`` with ``quota``: the ``seats`` of each group apportioned to its rows by Sainte-Lague.

    With ``d = sum(value) / seats`` no row's quota is further from ``value / d`` than half the number of rows times
    its share, and one or two for rounding; so the sure seats are counted and the rest are listed as quotients.
    Ties go to the earlier key. Nulls in ``group`` and ``key`` are keys like any other.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    stats = votes.withColumns({"__sum": F.sum(value).over(whole), "__n": F.count(F.lit(1)).over(whole)})
    fair = F.when(F.col("__sum") > 0, F.col(value) / F.col("__sum") * F.col(seats)).otherwise(F.lit(0.0))
    slack = F.when(F.col("__sum") > 0, F.col("__n") * F.col(value) / F.col("__sum") / 2).otherwise(F.lit(0.0)) + 2
    stats = stats.withColumns({"__sure": F.greatest(F.lit(0), F.floor(fair - slack)).cast("long"), "__most": F.ceil(fair + slack).cast("long")})
    listed = stats.where(F.col(value) > 0).select(*group, *key, seats, value, "__sure", F.explode(F.sequence(F.col("__sure"), F.col("__most"))).alias("__seat"))
    open_seats = F.col(seats) - F.sum(F.when(F.col("__seat") == F.col("__sure"), F.col("__sure")).otherwise(0)).over(whole)
    best = whole.orderBy((F.col(value) / (2 * F.col("__seat") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "__seat")
    won = listed.withColumns({"__open": open_seats, "__rank": F.row_number().over(best)}).where("__rank <= __open")
    extra = won.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("__extra"))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group + key]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    quota = F.when(F.col(value) > 0, F.col("__sure")).otherwise(0) + F.coalesce("__extra", F.lit(0))
    return stats.alias("a").join(extra.alias("b"), condition, "left").select(*[F.col(f"a.{c}") for c in votes.columns], quota.cast("long").alias("quota"))


def _with_cells(rows: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` joined with the cells that they lie in; cells are broadcast only where they are few."""
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    few = cells.count() <= MAX_BROADCAST_CELLS
    right = (F.broadcast(cells) if few else cells).alias("c")
    return rows.alias("r").join(right, condition).select("r.*", *[f"c.{c}" for c in cells.columns if c not in key])


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, rows_per_shard: int | None = None) -> DataFrame:
    """For each document doc_id, size, source_size, target, taken, and its source, weight and shard.

    Needs doc_id, text and source; other columns are ignored. Null text has size 0 and is never taken; a null source
    is a source of its own; rows that share a doc_id are told apart by size only, so equal rows are interchangeable;
    an empty table gives an empty result. ``taken`` is at most ``max_repeat * size``.
    """
    spark: SparkSession = docs.sparkSession
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))
    n_rows = sizes.count()
    rows_per_shard = rows_per_shard or max(LEAST_ROWS_PER_SHARD, ROOTS_PER_SHARD * math.isqrt(n_rows))
    shards = max(1, -(-n_rows // rows_per_shard))
    sizes = sizes.withColumns({"shard": F.pmod(seeded(seed + 1, F.col("doc_id")), F.lit(shards)).cast("int"), "place": seeded(seed, F.col("doc_id"))})
    aimed = cut(targets(sizes, weights, max_repeat))
    total = aimed.select(F.floor(F.coalesce(F.sum("target"), F.lit(0)) / block).cast("long")).first()[0]
    by_source = sainte_lague(aimed.withColumn("seats", F.lit(total)), [], ["source"], "target", "seats")
    by_source = cut(by_source.drop("seats").withColumnRenamed("quota", "source_quota"))
    cells = sizes.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = _with_cells(cells, by_source, ["source"])
    cells = cut(sainte_lague(cells, ["source"], ["shard"], "cell_size", "source_quota"))
    cells = cells.withColumn("goal", F.least(F.col("quota") * block, max_repeat * F.col("cell_size")))
    cells = cells.withColumns({"passes": F.when(F.col("cell_size") > 0, F.floor(F.col("goal") / F.col("cell_size"))).otherwise(F.lit(0)).cast("long")})
    cells = cells.withColumn("run", F.col("goal") - F.col("passes") * F.col("cell_size"))
    start = F.pmod(seeded(seed, F.col("shard"), F.col("source")), F.greatest(F.lit(1), F.expr(f"cell_size DIV {block}"))) * block
    cells = cells.withColumn("run_start", start)
    rows = _with_cells(sizes, cells.select("source", "shard", "source_size", "weight", "target", "cell_size", "passes", "run", "run_start"), ["source", "shard"])
    line = Window.partitionBy("source", "shard").orderBy("place", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("until", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("until"), b) - F.greatest(F.col("until") - F.col("size"), a))

    end = F.col("run_start") + F.col("run")
    taken = F.col("passes") * F.col("size") + overlap(F.col("run_start"), F.least(end, F.col("cell_size"))) + overlap(F.lit(0), end - F.col("cell_size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "weight", "shard")


def mixed_documents(docs: DataFrame, seed: int = 1, **options: int) -> DataFrame:
    """The documents of the mix with their columns as they were: each as often as its tokens taken fill it, rounded.

    Null and empty texts are in no mix; a null source is one of its own; rows that share doc_id, source and size share
    what the mix takes of them evenly; an empty table gives an empty result. Columns of any name are kept.
    """
    chosen = mix(docs, seed, **options).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    copies = F.round(F.col("taken") / F.col("rows") / F.col("size")).cast("int")
    chosen = chosen.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "size", "copies")
    # The row as one struct, so that no column of it clashes with the keys.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    condition = F.lit(True)
    for c in ("doc_id", "source", "size"):
        condition = condition & F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
    joined = packed.alias("d").join(chosen.alias("c"), condition).select("d.doc", "c.copies")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
