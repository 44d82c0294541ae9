"""Reshaping of statements: short identifiers, grouping, page ids, labels, resources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators.ranks import numbered

from quantspark.functions.text import unquoted

#: URI prefixes and their short forms (fixed values).
PREFIXES = {"http://www.wikidata.org/entity/statement/": "wds:", "http://www.wikidata.org/entity/": "wd:", "http://www.wikidata.org/prop/qualifier/": "pq:", "http://www.wikidata.org/prop/direct/": "wdt:", "http://www.wikidata.org/prop/": "p:"}
QUALIFIER_FIELDS = ["qualifier", "qualifier_value", "qualifier_lowerbound", "qualifier_upperbound", "qualifier_unit", "qualifier_time_precision"]
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def shortened(uri: Column) -> Column:
    """A URI with its prefix in short form; null for null, articles and unknown prefixes."""
    out = F.lit(None).cast("string")
    for prefix, short in sorted(PREFIXES.items(), key=lambda p: len(p[0])):
        out = F.when(uri.startswith(prefix), F.concat(F.lit(short), F.substring(uri, len(prefix) + 1, 1 << 20))).otherwise(out)
    return F.when(uri.contains("wikipedia.org"), F.lit(None)).otherwise(out)


def grouped(bindings: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """One row for each statement, with its qualifiers as an array of structs.

    Keys include the property, so all properties are grouped in one job. Null keys are keys; a statement without
    qualifiers has an empty array; bounds stay only where both are set. Qualifiers are sorted, so reruns agree.
    """
    both = F.col("lowerbound").isNotNull() & F.col("upperbound").isNotNull()
    keyed = bindings.withColumns({b: F.when(both, F.col(b)) for b in ("lowerbound", "upperbound")})
    names = ["qualifier", "value", "lowerbound", "upperbound", "unit", "time_precision"]
    entry = F.struct(*[F.col(f).alias(n) for f, n in zip(QUALIFIER_FIELDS, names, strict=True)])
    keys = ["property", "entity", "value", "unit", "article", "lowerbound", "upperbound", *(extra_keys or [])]
    return keyed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("qualifier").isNotNull(), entry))).alias("qualifiers"))


def concatenated(bindings: DataFrame, keys: list[str], column: str, separator: str = "|", order: str | None = None) -> DataFrame:
    """GROUP_CONCAT of a column, nulls as empty, in the order of ``order``."""
    entry = F.struct(F.col(order or column).alias("o"), F.coalesce(F.col(column), F.lit("")).alias("v"))
    return bindings.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]), separator).alias(column))


def with_pages(statements: DataFrame, page_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements with their page's id by decoded article URL, and the articles that have none."""
    keyed = statements.withColumn("url", unquoted(F.col("article")))
    found = keyed.join(page_map.select("url", "page_id"), "url")
    return found.drop("url"), keyed.join(page_map, "url", "left_anti").select("article").distinct()


def facts(statements: DataFrame, page_map: DataFrame) -> DataFrame:
    """The fact table: statements with page ids, short identifiers and a number for each."""
    paged, _ = with_pages(statements, page_map)
    columns = ["page_id", F.xxhash64("entity", "property", "value", "unit", "article").alias("fact_id"), "entity", "property", "value", F.col("lowerbound").alias("value_lowerbound"), F.col("upperbound").alias("value_upperbound"), "unit", "qualifiers", "article"]
    return paged.select(*columns)


def resources(bindings: DataFrame) -> DataFrame:
    """(kind, uri): the distinct entities, units, qualifiers, URI-valued qualifier values and qualifier units."""
    kinds = {"entities": "entity", "units": "unit", "qualifiers": "qualifier", "qualifiers_values": "qualifier_value", "qualifiers_units": "qualifier_unit"}
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("uri")) for k, c in kinds.items()])
    rows = bindings.select(F.explode(listed).alias("r")).select("r.*").where("uri IS NOT NULL")
    return rows.where((F.col("kind") != "qualifiers_values") | F.col("uri").startswith("http://")).distinct()


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def clean_labels(labels: DataFrame, stop: DataFrame) -> DataFrame:
    """Labels (kind, uri, alias) without stop words and repeats."""
    word = F.lower(F.col("alias"))
    return labels.join(stop, word == F.col("word"), "left_anti").dropDuplicates(["kind", "uri", "alias"])


def missing(requested: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that a cache doesn't hold yet."""
    return requested.select(key).distinct().join(cached, key, "left_anti")


def upsert(cached: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cached rows of keys that are not new, and the new rows."""
    return cached.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def read_through(requested: DataFrame, cached: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """The cache after a request: ``fetch`` gets the keys that it lacks, or all of them with ``force``."""
    wanted = requested.select(key).distinct() if force else missing(requested, cached, key)
    return upsert(cached, fetch(wanted), key)


def facts_by_page(facts: DataFrame) -> DataFrame:
    """(page_id, facts): each page's facts as an array in the order of fact_id; for documents that list them so."""
    rest = [c for c in facts.columns if c not in ("page_id", "fact_id")]
    return facts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", *rest))).alias("facts"))


def final_titles(titles: DataFrame, normalised: DataFrame, redirected: DataFrame) -> DataFrame:
    """Titles through normalisation and redirects (each a table source, target)."""
    step = titles
    for k, table in enumerate((normalised, redirected)):
        last = "title" if k == 0 else "final"
        step = step.join(table.select(F.col("source").alias(last), F.col("target").alias(f"__{k}")), last, "left").withColumn("final", F.coalesce(f"__{k}", last)).drop(f"__{k}")
    return step.select("title", "final")


def chunked(df: DataFrame, *order: str, size: int) -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows in ``order``, from 1."""
    return numbered(df, *order, name="__nth", start=0).select(*df.columns, (F.floor(F.col("__nth") / size) + 1).cast("int").alias("chunk"))
