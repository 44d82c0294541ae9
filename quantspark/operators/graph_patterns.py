"""Graph patterns over a triple table (s, p, o, o_lang) as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL, ALT_LABEL = "rdfs:label", "skos:altLabel"
ABBREVIATIONS = ("wdt:P246", "wdt:P1813")


def values(df: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """Only rows whose ``column`` is in the one-column table ``items``."""
    return df.join(items.toDF(column), column, "left_semi")


def pattern(triples: DataFrame, predicate: str | list[str], subject: str, obj: str) -> DataFrame:
    """(subject, obj) pairs of one predicate, or of any of several (a path alternative)."""
    named = [predicate] if isinstance(predicate, str) else predicate
    return triples.where(F.col("p").isin(named)).select(F.col("s").alias(subject), F.col("o").alias(obj))


def basic(*patterns: DataFrame) -> DataFrame:
    """A basic graph pattern: inner joins on shared variables."""
    out = patterns[0]
    for p in patterns[1:]:
        out = out.join(p, [c for c in out.columns if c in p.columns])
    return out


def optional(left: DataFrame, *patterns: DataFrame) -> DataFrame:
    """OPTIONAL: the inner pattern is joined first, so all its variables are bound or none."""
    inner = basic(*patterns)
    return left.join(inner, [c for c in left.columns if c in inner.columns], "left")


def in_language(triples: DataFrame, lang: str = "en") -> DataFrame:
    return triples.where(F.col("o_lang") == lang)


def labels(triples: DataFrame, items: DataFrame, discard_abbreviations: bool = False, lang: str = "en") -> DataFrame:
    """(item, label): labels and other names of items, without chemical symbols and short names if asked.

    A name that equals one of several abbreviations but not another is kept, as each binding is tested by itself.
    """
    names = pattern(in_language(triples, lang), [LABEL, ALT_LABEL], "item", "label")
    names = values(names, items, "item")
    if not discard_abbreviations:
        return names
    for k, p in enumerate(ABBREVIATIONS):
        names = optional(names, pattern(triples, p, "item", f"short_{k}")).where(~F.col("label").eqNullSafe(F.col(f"short_{k}")) | F.col(f"short_{k}").isNull())
    return names.select("item", "label")


def statements(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """Quantitative statements of properties with bounds, and a row for each qualifier (nulls where there is none)."""
    claim = basic(properties.toDF("property"), pattern(triples, "wikibase:claim", "property", "claim"), pattern(triples, "wikibase:statementValue", "property", "psv"))
    made = triples.select(F.col("s").alias("entity"), F.col("p").alias("claim"), F.col("o").alias("statement"))
    node = triples.select(F.col("s").alias("statement"), F.col("p").alias("psv"), F.col("o").alias("node"))
    base = basic(claim, made, node, pattern(triples, "wikibase:quantityAmount", "node", "value"), pattern(triples, "wikibase:quantityUnit", "node", "unit"), pattern(triples, "schema:about", "article", "entity"))
    base = optional(base, pattern(triples, "wikibase:quantityLowerBound", "node", "lowerbound"), pattern(triples, "wikibase:quantityUpperBound", "node", "upperbound"))
    qualifiers = triples.where(F.col("p").startswith("pq:")).select(F.col("s").alias("statement"), F.col("p").alias("qualifier"), F.col("o").alias("qualifier_value"))
    qualified = base.join(qualifiers, "statement", "left")
    full = triples.where(F.col("p").startswith("pqv:")).select(F.col("s").alias("statement"), F.regexp_replace("p", "^pqv:", "pq:").alias("qualifier"), F.col("o").alias("qualifier_node"))
    detail = full
    for predicate, name in (("wikibase:quantityUnit", "qualifier_unit"), ("wikibase:timePrecision", "qualifier_time_precision")):
        detail = optional(detail, pattern(triples, predicate, "qualifier_node", name))
    detail = optional(detail, pattern(triples, "wikibase:quantityLowerBound", "qualifier_node", "qualifier_lowerbound"), pattern(triples, "wikibase:quantityUpperBound", "qualifier_node", "qualifier_upperbound"))
    out = qualified.join(detail.drop("qualifier_node"), ["statement", "qualifier"], "left")
    columns = ["property", "article", "entity", "statement", "value", "unit", "lowerbound", "upperbound", "qualifier", "qualifier_value", "qualifier_unit", "qualifier_lowerbound", "qualifier_upperbound", "qualifier_time_precision"]
    return out.select(*columns).distinct()


def limited(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each ``by``, with ``hit_limit`` where there are so many."""
    ranked = df.withColumn("__nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__nth") <= most)
    return ranked.withColumn("hit_limit", F.count(F.lit(1)).over(Window.partitionBy(by)) >= most).drop("__nth")


def property_catalogue(triples: DataFrame, kind: str = "wikibase:Quantity", only: DataFrame | None = None) -> DataFrame:
    """(property, labels): properties of a type with all their names."""
    typed = pattern(triples.where(F.col("o") == kind), "wikibase:propertyType", "item", "type").select("item")
    if only is not None:
        typed = values(typed, only, "item")
    return labels(triples, typed).groupBy(F.col("item").alias("property")).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def constant_catalogue(triples: DataFrame, kind: str = "wd:Q173227", lang: str = "en") -> DataFrame:
    """(item, label, alt_label): instances of a class with their label, and a row for each other name (null without one)."""
    items = pattern(triples.where(F.col("o") == kind), "wdt:P31", "item", "class").select("item").distinct()
    named = in_language(triples, lang)
    return optional(optional(items, pattern(named, LABEL, "item", "label")), pattern(named, ALT_LABEL, "item", "alt_label"))


def descendants(triples: DataFrame, predicate: str, roots: DataFrame) -> DataFrame:
    """(root, node): everything that a chain of ``predicate`` leads from to a root, the root included.

    A driver loop over a frontier that is checkpointed each round; rounds are as many as the longest chain.
    """
    from quantspark.sources.tables import cut

    edges = pattern(triples, predicate, "child", "node")
    found = cut(roots.toDF("root").select("root", F.col("root").alias("node")))
    frontier = found
    while True:
        nearer = frontier.join(edges, "node").select("root", F.col("child").alias("node")).distinct()
        frontier = cut(nearer.join(found, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))
