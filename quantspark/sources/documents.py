"""One very large JSON document as a table of entries, read in byte ranges.

Spark's text reader cuts a file at commas, in as many ranges as it has blocks. What the document's order decides for a
piece between two commas (is it inside a string, how deep does it lie, whose entry is it) are running sums or last
values: each block finds them for itself, and blocks then take over what the blocks before them end with. So no task holds
more than a block's pieces or one entry, however large the document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quantspark.sources.tables import cut

_BLOCK = ["file", "block"]


def _inside() -> WindowSpec:
    """Pieces in their order within a block."""
    return Window.partitionBy(*_BLOCK).orderBy("nth")


def _before() -> WindowSpec:
    """The blocks of a file that start before a block."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _summed(pieces: DataFrame, n: Column, name: str) -> DataFrame:
    """``pieces`` with the sum of ``n`` over all pieces before each in its file. One row a block goes through one task."""
    rows = pieces.withColumn("__n", n)
    before = rows.groupBy(*_BLOCK).agg(F.sum("__n").alias("__n")).select(*_BLOCK, F.coalesce(F.sum("__n").over(_before()), F.lit(0)).alias("__before"))
    own = F.sum("__n").over(_inside()) - F.col("__n")
    return rows.withColumn("__own", own).join(before, _BLOCK).select(*pieces.columns, (F.col("__own") + F.col("__before")).alias(name))


def _carried(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """``pieces`` with the last ``value`` that isn't null, at or before each in its file."""
    rows = cut(pieces.withColumn("__last", F.last(value, ignorenulls=True).over(_inside())))
    ends = rows.groupBy(*_BLOCK).agg(F.max_by("__last", "nth").alias("__end"))
    before = ends.select(*_BLOCK, F.last("__end", ignorenulls=True).over(_before()).alias("__before"))
    return rows.join(before, _BLOCK).select(*pieces.columns, F.coalesce("__last", "__before").alias(name))


def json_entries(spark: SparkSession, path: str, levels: dict[str, int]) -> DataFrame:
    """(file, keys, value): the entries of JSON documents, one object in each file of ``path``, any layout.

    ``levels`` names keys of the object and how many keys lead to an entry below each: with 2, ``{"a": {"x": V}}`` gives
    (["a", "x"], V); V is the entry's JSON text. Members of other names are passed over, as are values that end before
    their level (``{"a": {}}``, ``{"a": null}``). Repeated keys give an entry each. Compressed files are one range each.
    An empty file or object has no entries.
    """
    text = spark.read.option("lineSep", ",").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("piece"))
    # Escaped characters decide nothing; without them a quote always ends or begins a string.
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    pieces = cut(_summed(pieces, quotes, "quotes").withColumn("inside", F.col("quotes") % 2 == 1).drop("quotes"))
    outside = F.regexp_replace(F.when(F.col("inside"), F.concat(F.lit('"'), plain)).otherwise(plain), r'"[^"]*(?:"|$)', "")
    count = lambda signs: F.length(F.regexp_replace(outside, f"[^{signs}]", ""))
    pieces = cut(_summed(pieces.withColumn("step", count(r"\[{") - count(r"\]}")), F.col("step"), "depth"))
    begins = ~F.col("inside")
    listed = "|".join(r"\Q" + k + r"\E" for k in levels)
    top = F.when(begins & (F.col("depth") <= 1), F.regexp_extract("piece", rf'^[\s\uFEFF{{]*"({listed})"\s*:', 1))
    pieces = _carried(pieces, top, "top")
    level = F.coalesce(*[F.when(F.col("top") == k, n) for k, n in levels.items()])
    pieces = pieces.withColumn("level", level).where("level IS NOT NULL")
    first = F.when(begins & (F.col("depth") <= F.col("level")), F.struct("block", "nth", "depth"))
    pieces = _carried(pieces, first, "first")
    last = lambda c: F.max_by(c, F.struct("block", "nth"))
    entries = pieces.groupBy("file", "top", "level", "first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "piece"))), lambda p: p["piece"]), ",").alias("text"), last(F.col("depth") + F.col("step")).alias("end")
    )
    # Keys that the text begins with, each of which opens an object but for the last.
    key = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    chain = F.regexp_extract("text", rf"^[\s\uFEFF{{]*(?:{key}\s*:[\s{{]*+)*", 0)
    opened = F.from_json(F.concat(F.lit("["), F.array_join(F.regexp_extract_all(chain, F.lit(f"({key})"), F.lit(1)), ","), F.lit("]")), "array<string>")
    depth = F.greatest(F.col("first.depth"), F.lit(1))
    own = F.slice(opened, F.lit(1), F.greatest(F.col("level") - depth + 1, F.lit(0)))
    entries = cut(entries.select("file", F.col("first.block").alias("block"), F.col("first.nth").alias("nth"), depth.alias("depth"), "level", "text", "end", own.alias("own")))
    for k in range(1, max(levels.values())):
        # A key of an upper level holds until another one of its level or above begins.
        here = F.when(F.col("depth") <= k, F.struct(F.get("own", k - F.col("depth")).alias("key")))
        entries = _carried(entries, here, f"key{k}")
    above = F.array(*[F.col(f"key{k}.key") for k in range(1, max(levels.values()))]) if max(levels.values()) > 1 else F.array().cast("array<string>")
    keys = F.concat(F.slice(above, F.lit(1), F.col("depth") - 1), F.col("own"))
    # The value follows the last of the entry's own keys; after it the objects around it end.
    lead = F.concat(F.lit(rf"^[\s\uFEFF{{]*(?:{key}\s*:[\s{{]*?){{"), F.size("own").cast("string"), F.lit("}"))
    tail = F.concat(F.lit(r"(?:\s*\}){"), F.greatest(F.col("level") - F.col("end"), F.lit(0)).cast("string"), F.lit(r"}\s*$"))
    value = F.trim(F.regexp_replace(F.regexp_replace("text", lead, F.lit("")), tail, F.lit("")))
    return entries.select("file", keys.alias("keys"), value.alias("value"), "level").where("size(keys) = level AND value <> ''").drop("level")
