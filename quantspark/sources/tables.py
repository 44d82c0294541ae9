"""Parquet tables, JSON lines, reports, and cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark import schemas


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def kept(df: DataFrame, *paths: str) -> DataFrame:
    """The rows of ``df``, computed once; the scratch tables at ``paths``, which they were read from, are removed."""
    out = cut(df)
    removed(df.sparkSession, *paths)
    return out


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of this run."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a temporary folder only under a local master."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quantspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(mode, qid, n) as the unit-frequencies job wrote it."""
    return spark.read.schema(schemas.UNIT_FREQUENCIES).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parsed pages from JSON lines; broken lines become rows of nulls and are dropped."""
    pages = spark.read.schema(schemas.PAGES_PARSED).option("mode", "PERMISSIVE").json(path)
    return pages.where("id IS NOT NULL")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines in UTF-8; null fields are left out."""
    df.write.mode(mode).json(path)


def write_examples(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Only rows in which one of the array ``columns`` has entries."""
    some = F.lit(False)
    for c in columns:
        some = some | (F.coalesce(F.size(c), F.lit(0)) > 0)
    write_json_lines(df.where(some), path, mode)


def write_dropped(df: DataFrame, path: str) -> None:
    """Rows with a ``drop_reason``, for inspection."""
    write_json_lines(df.where("drop_reason IS NOT NULL"), path)


def write_knowledge(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The knowledge tables (facts, labels, unit_conversions, page_map) as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_knowledge(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    known = {"facts": schemas.FACTS, "labels": schemas.LABELS, "unit_conversions": schemas.UNIT_CONVERSIONS}
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in known.items()}


def knowledge_totals(facts: DataFrame) -> DataFrame:
    """Number of facts and of pages with facts."""
    return facts.agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("page_id").alias("n_pages"))


def read_knowledge_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables from one nested JSON document (labels by kind and URI, statements by page id, conversions by unit).

    The document is read in byte ranges, so that it may be of any size; its entries are parsed one by one.
    """
    from quantspark.sources.documents import json_entries

    entries = cut(json_entries(spark, path, {"labels": 3, "quantitative_statements": 2, "unit_conversion_data": 2}))
    below = lambda top, *names: entries.where(F.get("keys", F.lit(0)) == top).select(*[F.get("keys", F.lit(k)).alias(n) for k, n in enumerate(names, 1)], "value")
    labels = below("labels", "kind", "uri").select("kind", "uri", F.explode(F.from_json("value", "array<string>")).alias("alias"))
    fact = f"array<struct<entity:string,property:string,value:string,value_lowerbound:string,value_upperbound:string,unit:string,qualifiers:{schemas.QUALIFIERS},article:string>>"
    facts = below("quantitative_statements", "page").select(F.col("page").cast("long").alias("page_id"), F.posexplode(F.from_json("value", fact)).alias("n", "f"))
    facts = facts.select("page_id", F.xxhash64("page_id", "n").alias("fact_id"), "f.*")
    conversions = below("unit_conversion_data", "from_unit").select("from_unit", F.explode(F.from_json("value", "array<struct<to_unit:string,conv_factor_numerator:string,conv_factor_denominator:string>>")).alias("t"))
    conversions = conversions.select("from_unit", F.col("t.to_unit").alias("to_unit"), F.col("t.conv_factor_numerator").alias("num"), F.col("t.conv_factor_denominator").alias("den"))
    return {"facts": facts, "labels": labels, "unit_conversions": conversions}


def report(content: dict, path: str) -> None:
    """A small report as indented JSON; for figures, never for tables."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(content, out, ensure_ascii=False, indent=4)
