"""Queries of graph patterns, statements, labels and units, over triples made of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions import units
from quantspark.operators import frequency, graph_patterns, matching, statements
from quantspark.plans import knowledge
from quantspark.plans.registry import letters, query, table, values
from quantspark.session import ship

WD, PQ = "http://www.wikidata.org/entity/", "http://www.wikidata.org/prop/qualifier/"
#: Suppliers as entities with one balance each; which of them have bounds, qualifiers or short names follows from their key.
_S = "supplier"


def supplier_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    e, st, node, article = F.concat(F.lit("wd:S"), key), F.concat(F.lit("st"), key), F.concat(F.lit("n"), key), F.concat(F.lit("w/S%20"), key)
    q = F.concat(F.lit("t"), key)

    def t(subject, p, o, when=None, lang=None):
        row = F.struct(subject.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang"))
        return row if when is None else F.when(when, row)

    name = F.concat(F.lit("Firm "), F.expr(letters("s_suppkey")))
    rows = F.array(
        t(e, "p:P1", st), t(st, "psv:P1", node), t(node, "wikibase:quantityAmount", F.col("s_acctbal").cast("string")), t(node, "wikibase:quantityUnit", F.when(k % 2 == 0, "Q1").otherwise("Q2")),
        t(node, "wikibase:quantityLowerBound", (k - 1).cast("string"), k % 2 == 0), t(node, "wikibase:quantityUpperBound", (k + 1).cast("string"), k % 3 == 0),
        t(st, "pq:P585", F.lit("2000-01-01T00:00:00Z"), k % 4 == 0), t(st, "pqv:P585", q, k % 4 == 0), t(q, "wikibase:timePrecision", F.lit("9"), k % 4 == 0),
        t(st, "pq:P518", F.concat(F.lit(WD + "N"), F.col("s_nationkey").cast("string")), k % 5 == 0), t(article, "schema:about", e),
        t(e, "rdfs:label", name, lang="en"), t(e, "rdfs:label", F.concat(name, F.lit(" GmbH")), lang="de"), t(e, "skos:altLabel", F.concat(F.lit("F"), key), lang="en"), t(e, "wdt:P1813", F.concat(F.lit("F"), key), k % 7 == 0),
    )
    return s.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def schema_triples(spark: SparkSession) -> DataFrame:
    return values(spark, "('wdt:P1', 'wikibase:propertyType', 'wikibase:Quantity', CAST(NULL AS STRING)), ('wdt:P1', 'wikibase:claim', 'p:P1', NULL), ('wdt:P1', 'wikibase:statementValue', 'psv:P1', NULL), ('wdt:P1', 'rdfs:label', 'balance', 'en'), ('Q1', 'rdfs:label', 'dollar', 'en'), ('Q2', 'rdfs:label', 'of', 'en'), ('Q2', 'skos:altLabel', 'peso', 'en')", "s, p, o, o_lang")


_BOTH = "s_suppkey % 6 = 0"
_STATEMENTS = f"""SELECT 'wd:S' || s_suppkey AS entity, CAST(s_acctbal AS VARCHAR) AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'Q1' ELSE 'Q2' END AS unit,
  CASE WHEN {_BOTH} THEN CAST(s_suppkey - 1 AS VARCHAR) END AS lowerbound, CASE WHEN {_BOTH} THEN CAST(s_suppkey + 1 AS VARCHAR) END AS upperbound, q.qualifier, q.qualifier_value, q.precision AS qualifier_time_precision
FROM supplier LEFT JOIN LATERAL (SELECT 'pq:P585' AS qualifier, '2000-01-01T00:00:00Z' AS qualifier_value, '9' AS precision WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'pq:P518', '{WD}N' || s_nationkey, NULL WHERE s_suppkey % 5 = 0) q ON true"""


@query(_STATEMENTS)
def statement_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bindings of quantitative statements: bounds only where both are stated, a row for each qualifier or none."""
    triples = supplier_triples(spark, sf_dir).unionByName(schema_triples(spark))
    found = graph_patterns.statements(triples, graph_patterns.property_catalogue(triples).select("property"))
    return found.select("entity", "value", "unit", "lowerbound", "upperbound", "qualifier", "qualifier_value", "qualifier_time_precision")


@query(f"WITH b AS ({_STATEMENTS}) SELECT entity, value, lowerbound, count(qualifier)::INTEGER AS n_qualifiers, coalesce(string_agg(qualifier || '=' || qualifier_value || coalesce('@' || qualifier_time_precision, ''), ' ' ORDER BY qualifier) FILTER (qualifier IS NOT NULL), '') AS qualifiers FROM b GROUP BY ALL")
def statements_with_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = supplier_triples(spark, sf_dir).unionByName(schema_triples(spark))
    rows = statements.grouped(graph_patterns.statements(triples, graph_patterns.property_catalogue(triples).select("property")))
    shown = F.array_join(F.transform("qualifiers", lambda q: F.concat(q["qualifier"], F.lit("="), q["value"], F.coalesce(F.concat(F.lit("@"), q["time_precision"]), F.lit("")))), " ")
    return rows.select("entity", "value", "lowerbound", F.size("qualifiers").alias("n_qualifiers"), shown.alias("qualifiers"))


@query(f"WITH b AS ({_STATEMENTS}) SELECT DISTINCT 'entities' AS kind, entity AS uri FROM b UNION ALL SELECT DISTINCT 'units', unit FROM b UNION ALL SELECT DISTINCT 'qualifiers', qualifier FROM b WHERE qualifier IS NOT NULL UNION ALL SELECT DISTINCT 'qualifiers_values', qualifier_value FROM b WHERE qualifier_value LIKE 'http://%'")
def distinct_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = supplier_triples(spark, sf_dir).unionByName(schema_triples(spark))
    return statements.resources(graph_patterns.statements(triples, graph_patterns.property_catalogue(triples).select("property")))


@query(f"WITH n AS (SELECT s_suppkey AS k, 'wd:S' || s_suppkey AS item, 'Firm ' || {letters('s_suppkey')} AS name FROM supplier WHERE s_suppkey % 3 > 0) SELECT item, name AS label FROM n UNION ALL SELECT item, 'F' || k FROM n WHERE k % 7 > 0")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English labels and other names of chosen items, without short names."""
    triples = supplier_triples(spark, sf_dir)
    items = table(spark, sf_dir, _S).where("s_suppkey % 3 > 0").select(F.concat(F.lit("wd:S"), "s_suppkey").alias("item"))
    return graph_patterns.labels(triples, items, discard_abbreviations=True)


@query(f"SELECT 'entities' AS kind, 'wd:S' || s_suppkey AS uri, 'Firm ' || {letters('s_suppkey')} AS alias FROM supplier UNION ALL SELECT 'entities', 'wd:S' || s_suppkey, 'F' || s_suppkey FROM supplier WHERE s_suppkey % 7 > 0 UNION ALL SELECT 'properties', 'wdt:P1', 'balance' UNION ALL SELECT 'units', 'Q1', 'dollar' UNION ALL SELECT 'units', 'Q2', 'peso'")
def knowledge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the whole knowledge job: entities without short names, units without stop words."""
    triples = supplier_triples(spark, sf_dir).unionByName(schema_triples(spark))
    page_map = values(spark, "('w/x', 1L)", "url, page_id")
    config = values(spark, "('Q1', CAST(NULL AS STRING), CAST(NULL AS STRING))", "qid, si_label, factor")
    return knowledge.build(triples, page_map, config, statements.stop_words(spark))["labels"]


@query("SELECT 'w/S%20' || s_suppkey AS article, CASE WHEN s_suppkey % 9 > 0 THEN 1000 + s_suppkey END AS page_id, s_suppkey % 9 = 0 AS missing FROM supplier")
def facts_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with the ids of their pages by decoded address, and the addresses that have none."""
    s = table(spark, sf_dir, _S)
    rows = s.select(F.concat(F.lit("w/S%20"), "s_suppkey").alias("article"))
    page_map = s.where("s_suppkey % 9 > 0").select(F.concat(F.lit("w/S "), "s_suppkey").alias("url"), (F.col("s_suppkey") + 1000).alias("page_id"))
    found, missed = statements.with_pages(rows, page_map)
    return found.select("article", "page_id", F.lit(False).alias("missing")).unionByName(missed.select("article", F.lit(None).cast("long").alias("page_id"), F.lit(True).alias("missing")))


@query("SELECT s_nationkey AS page_id, count(*)::INTEGER AS n, string_agg('wd:S' || s_suppkey, ' ' ORDER BY s_suppkey) AS entities FROM supplier GROUP BY s_nationkey")
def facts_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, _S).select(F.col("s_nationkey").cast("long").alias("page_id"), F.col("s_suppkey").alias("fact_id"), F.concat(F.lit("wd:S"), "s_suppkey").alias("entity"))
    pages = statements.facts_by_page(facts)
    return pages.select("page_id", F.size("facts").alias("n"), F.array_join(F.transform("facts", lambda f: f["entity"]), " ").alias("entities"))


_URIS = [(WD, "wd:"), ("http://www.wikidata.org/prop/direct/", "wdt:"), (PQ, "pq:"), ("http://www.wikidata.org/prop/", "p:"), ("https://en.wikipedia.org/wiki/", None), ("http://other.org/", None)]


@query("SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN " + (f"'{short}' || p_partkey" if short else "NULL") for k, (_, short) in enumerate(_URIS)) + " END AS short FROM part")
def short_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(u) for u, _ in _URIS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", statements.shortened(F.concat(prefix, F.col("p_partkey").cast("string"))).alias("short"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r AS (SELECT k AS root, k AS node FROM (VALUES (1), (2), (5)) AS t(k) UNION SELECT r.root, e.child FROM r JOIN e ON e.parent = r.node) SELECT 'n' || root AS root, 'n' || node AS node FROM r")
def part_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below three nodes of a tree of parts."""
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    triples = part.select(node(F.col("p_partkey")).alias("s"), F.lit("sub").alias("p"), node(F.floor(F.col("p_partkey") / 3)).alias("o")).unionByName(part.select(node(F.col("p_partkey")).alias("s"), F.lit("other").alias("p"), F.lit("n1").alias("o")))
    return graph_patterns.descendants(triples, "sub", values(spark, "('n1'), ('n2'), ('n5')", "root"))


@query("SELECT 'wd:' || p_partkey AS item, p_name AS label, CASE WHEN p_size % 2 = 0 THEN p_brand END AS alt_label FROM part WHERE p_size > 20")
def constant_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("wd:"), F.col("p_partkey").cast("string")))
    t = lambda p, o, lang, when: F.when(when, F.struct("s", F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang")))
    rows = F.array(t("wdt:P31", F.lit("wd:Q173227"), None, F.col("p_size") > 20), t("rdfs:label", F.col("p_name"), "en", F.lit(True)), t("rdfs:label", F.col("p_type"), "de", F.lit(True)), t("skos:altLabel", F.col("p_brand"), "en", F.col("p_size") % 2 == 0))
    return graph_patterns.constant_catalogue(part.select(F.inline(F.filter(rows, lambda r: r.isNotNull()))))


# Units: parts of one colour have one SI unit, with their size as factor; large ones have none.
_CONFIG = "(SELECT 'U' || p_partkey AS qid, CASE WHEN p_size < 48 THEN split_part(p_name, ' ', 1) || p_brand END AS si_label, CAST(p_size AS VARCHAR) AS factor FROM part)"


def unit_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_size") < 48, F.concat(F.substring_index("p_name", " ", 1), "p_brand"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("U"), "p_partkey").alias("qid"), label.alias("si_label"), F.col("p_size").cast("string").alias("factor"))


@query(f"SELECT a.qid AS from_unit, b.qid AS to_unit, a.factor AS num, b.factor AS den FROM {_CONFIG} a JOIN {_CONFIG} b ON a.si_label = b.si_label UNION ALL SELECT qid, qid, '1', '1' FROM {_CONFIG} WHERE si_label IS NULL")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_conversions(unit_config(spark, sf_dir))


@query(f"SELECT a.qid AS from_unit, b.qid AS to_unit FROM {_CONFIG} a JOIN {_CONFIG} b ON a.si_label = b.si_label WHERE a.factor::DOUBLE / b.factor::DOUBLE BETWEEN 0.05 AND 20 OR a.factor::INTEGER = 10 * b.factor::INTEGER OR b.factor::INTEGER = 10 * a.factor::INTEGER")
def considered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units within a factor of twenty, or a power of ten away."""
    return units.considered_pairs(unit_config(spark, sf_dir), 20.0)


@query(f"WITH c AS (SELECT a.qid AS from_unit, b.qid AS to_unit, b.factor::INTEGER AS f FROM {_CONFIG} a JOIN {_CONFIG} b ON a.si_label = b.si_label) SELECT from_unit, to_unit FROM c WHERE f % 3 > 0 AND f % 5 > 0")
def excluded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions to units that have a label (no multiple of three) and are found at all (no multiple of five)."""
    config = unit_config(spark, sf_dir).where("si_label IS NOT NULL")
    size = F.col("factor").cast("int")
    counts = config.select("qid", F.when(size % 5 > 0, 4).otherwise(0).alias("n"))
    # Units are excluded before they are paired, so no pair is made in vain.
    targets = frequency.excluded(config, counts, config.where(size % 3 == 0).select("qid"), infrequent=True, unit="qid")
    return units.pairs_with(config, targets)


@query("SELECT DISTINCT lower(p_name) AS alias FROM part WHERE p_size % 3 > 0")
def frequent_unit_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of units that are counted at least once; aliases that are numbers are none."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("U"), "p_partkey").alias("qid"), "p_name", "p_size")
    counts = part.select("qid", (F.col("p_size") % 3).alias("n"))
    labels = part.select(F.lit("units").alias("kind"), F.col("qid").alias("uri"), F.explode(F.array(F.lower("p_name"), F.col("p_size").cast("string"))).alias("alias"))
    return frequency.frequent_aliases(frequency.top(counts, mode="not_zero"), labels)


@query("SELECT 'U' || p_size AS qid FROM part UNION SELECT 'V' || (p_size + 1) FROM part UNION SELECT 'U' || (p_size % 7) FROM part")
def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct units of facts and of what they convert to."""
    from quantspark.plans.unit_frequencies import units_of

    part = table(spark, sf_dir, "part")
    unit = F.concat(F.lit("U"), F.col("p_size").cast("string"))
    other = F.explode(F.array(F.concat(F.lit("V"), (F.col("p_size") + 1).cast("string")), F.concat(F.lit("U"), (F.col("p_size") % 7).cast("string"))))
    return units_of(part.select(unit.alias("unit")), part.select(other.alias("to_unit")))


@query("SELECT DISTINCT 'U' || p_size AS qid FROM part WHERE p_size % 4 > 0")
def units_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    unit = F.concat(F.lit("U"), F.col("p_size").cast("string"))
    labels = part.where("p_size % 4 = 0").select(F.lit("units").alias("kind"), unit.alias("uri"), F.col("p_name").alias("alias"))
    return frequency.unlabelled(part.select(unit.alias("qid")).distinct(), labels)


@query("WITH c AS (SELECT p_partkey AS qid, p_size AS n FROM part), f AS (SELECT *, row_number() OVER (ORDER BY n DESC, qid) AS a, row_number() OVER (ORDER BY n, qid) AS b FROM c) SELECT qid, n, 'top' AS side FROM f WHERE a <= 100 UNION ALL SELECT qid, n, 'bottom' FROM f WHERE b <= 100")
def unit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most and least frequent units."""
    top, bottom = frequency.ends(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.col("p_size").alias("n")))
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


# Suppliers' balances as facts in one of three linear units, or as temperatures.
_FACTORS = "(VALUES ('Q1', 'Q1', 1.0, 1.0), ('Q1', 'Q3', 1.0, 1000.0), ('Q1', 'Q4', 1.0, 7000.0), ('Q1', 'Q5', 3.0, 8.0), ('Q2', 'Q2', 1.0, 1.0))"


@query(f"SELECT s_suppkey AS fact_id, to_unit AS unit, round(s_acctbal * num / den, 6) AS target, to_unit = from_unit AS as_stated FROM supplier JOIN {_FACTORS} AS c(from_unit, to_unit, num, den) ON from_unit = 'Q' || (1 + s_suppkey % 3) WHERE to_unit <> 'Q4' UNION ALL SELECT s_suppkey, unit, round(v, 6), unit = 'Q25267' FROM (SELECT s_suppkey, unnest(['Q25267', 'Q11579', 'Q42289']) AS unit, unnest([s_acctbal, s_acctbal + 273.15, s_acctbal * 9 / 5 + 32]) AS v FROM supplier WHERE s_suppkey % 3 = 2)")
def fact_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in all units in which a text may state them; one unit is too far from the stated one."""
    ship(spark)
    null = F.lit(None).cast("string")
    unit = F.when(F.col("s_suppkey") % 3 == 2, units.CELSIUS).otherwise(F.concat(F.lit("Q"), (1 + F.col("s_suppkey") % 3).cast("string")))
    facts = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page_id"), F.col("s_suppkey").alias("fact_id"), F.col("s_acctbal").cast("string").alias("value"), null.alias("value_lowerbound"), null.alias("value_upperbound"), unit.alias("unit"))
    conversions = values(spark, "('Q1', 'Q1', '1', '1'), ('Q1', 'Q3', '1', '1000'), ('Q1', 'Q4', '1', '7000'), ('Q1', 'Q5', '3', '8'), ('Q2', 'Q2', '1', '1')", "from_unit, to_unit, num, den")
    rows = matching.variants(facts, conversions)
    return rows.select("fact_id", "unit", F.round("target", 6).alias("target"), F.col("target_text").isNotNull().alias("as_stated"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'cached' END AS origin, 'some' AS run FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'cached' END, 'forced' FROM customer")
def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second key is asked for; a quarter of all isn't cached. With force what is asked for is fetched again."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    cached = keys.where("key % 4 <> 0").withColumn("origin", F.lit("cached"))
    fetch = lambda wanted: wanted.withColumn("origin", F.lit("new"))
    runs = {name: statements.read_through(keys.where("key % 2 = 0"), cached, "key", fetch, force) for name, force in (("some", False), ("forced", True))}
    return runs["some"].withColumn("run", F.lit("some")).unionByName(runs["forced"].withColumn("run", F.lit("forced")))


@query("SELECT c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'End ' || c_custkey WHEN c_custkey % 2 = 0 THEN 'Normal ' || c_custkey ELSE c_name END AS final FROM customer")
def final_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles through normalisation (even keys) and redirects (multiples of three, from whatever they are by then)."""
    c = table(spark, sf_dir, "customer")
    normal = F.concat(F.lit("Normal "), F.col("c_custkey").cast("string"))
    moved = c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, normal).otherwise(F.col("c_name")).alias("source"), F.concat(F.lit("End "), F.col("c_custkey").cast("string")).alias("target"))
    return statements.final_titles(c.select(F.col("c_name").alias("title")), c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("source"), normal.alias("target")), moved)


@query("SELECT o_orderkey, year(o_orderdate) = 1997 OR o_orderkey % 3 = 0 AS hit FROM orders WHERE year(o_orderdate) = 1997 OR o_orderkey % 3 = 0")
def dated_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated dates against known years: 1997 for most, the order's own month for a third; equal at the coarser precision."""
    ship(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    own = F.col("o_orderkey") % 3 == 0
    known = o.select("o_orderkey", F.when(own, F.date_format("at", "'+'yyyy-MM-'00T00:00:00Z'")).otherwise("+1997-00-00T00:00:00Z").alias("value"), F.when(own, "10").otherwise("9").alias("time_precision"))
    stated = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("at", "MMMM d, yyyy")).otherwise(F.date_format("at", "d MMMM yyyy")).alias("date_text"))
    return matching.date_matches(known, stated, ["o_orderkey"]).select("o_orderkey", F.lit(True).alias("hit"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, ['day', 'day', 'day', 'month', 'year', 'day'][o_orderkey % 6 + 1] AS kind FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN date_trunc('month', o_orderdate) WHEN o_orderkey % 6 = 4 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END AS o_orderdate FROM orders)")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in six notations, with the precision that each gives."""
    from quantspark.functions.dates import parse_date

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    notation = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == k, F.date_format("at", f)) for k, f in enumerate(["MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "MMMM yyyy", "yyyy", "d'th of' MMMM yyyy"])])
    rows = o.select("o_orderkey", notation.alias("text")).withColumn("d", F.explode(F.array(parse_date(F.col("text")))))
    return rows.select("o_orderkey", F.date_format("d.at", "yyyy-MM-dd").alias("day"), F.col("d.precision").alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'point_in_time' WHEN 2 THEN 'start_time' WHEN 3 THEN 'coordinate_location' WHEN 4 THEN 'location' WHEN 5 THEN NULL WHEN 6 THEN 'applies_to_part' ELSE 'some_qualifier' END AS tag FROM lineitem")
def qualifier_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.element_at(F.array(*[F.lit(f"pq:{p}") for p in ("P585", "P580", "P625", "P276", "P1352", "P518", "P99")]), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", matching.qualifier_tag(codes).alias("tag"))
