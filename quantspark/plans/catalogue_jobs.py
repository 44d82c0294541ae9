"""Queries of sources, sinks and whole jobs, over pages and facts made of the tables' rows."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions import spans
from quantspark.operators import frequency, statements
from quantspark.plans import context, parse, quantity, statistics, unit_frequencies
from quantspark.plans.registry import letters, made, query, table, values
from quantspark.session import ship
from quantspark.sources import dump, endpoint, tables

# --- Sources and sinks: written in the shared folder and read back -----------------------------------------------------


@query("SELECT s_suppkey AS id, s_name AS title, 'It has ' || s_nationkey || ' & more <b>.' AS text FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 ORDER BY s_suppkey LIMIT 40 OFFSET 3")
def dump_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed dump with other namespaces and redirects in it; a job that skips three articles and takes forty."""
    s = table(spark, sf_dir, "supplier")
    text = F.when(F.col("s_suppkey") % 5 == 0, "#redirect [[Other]]").otherwise(F.concat(F.lit("It has "), F.col("s_nationkey").cast("string"), F.lit(" & more <b>.")))
    body = F.struct(F.struct(text.alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text"))
    pages = s.select(F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0).alias("ns"), F.col("s_suppkey").alias("id"), body.alias("revision"))
    path = tables.scratch(spark, "simplewiki-dump")
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").option("compression", "bzip2").save(path)
    return tables.kept(parse.parse(spark, dump.DumpJob(path, "raw", limit=40, page_offset=3)), path)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'no_text' END AS error, CASE WHEN doc_id % 5 > 0 THEN 1 END AS n_quantities FROM documents")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of which every fifth has no text: pages and errors from the one scan that writes both."""
    text = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("It is {{convert|"), F.col("n_chars").cast("string"), F.lit("|km|mi}} long.")))
    path = tables.scratch(spark, "parsed")
    pages, failed = parse.written_apart(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), text.alias("text")), path)
    good = pages.select("id", F.lit(None).cast("string").alias("error"), F.size("quantities").alias("n_quantities"))
    return tables.kept(good.unionByName(failed.select("id", "error", F.lit(None).cast("int").alias("n_quantities"))), path)


@query("SELECT doc_id AS id, source AS title, len(string_split(text, chr(10)))::INTEGER AS n_paragraphs, (doc_id % 3 > 0) AS quantity_read FROM documents WHERE text IS NOT NULL")
def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages as JSON lines; a quantity that could not be read stays null in its place."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    one = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("1 m"), F.lit("3 ft"), F.lit("1 m (3 ft)")))
    path = tables.scratch(spark, "pages")
    tables.write_json_lines(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.array(F.split("text", "\n")).alias("text"), F.array(one).alias("quantities")), path)
    pages = tables.read_pages(spark, path)
    return tables.kept(pages.select("id", "title", F.size(F.get("text", F.lit(0))).alias("n_paragraphs"), F.get("quantities", F.lit(0)).isNotNull().alias("quantity_read")), path)


@query("SELECT o_orderkey AS id, o_orderkey % 3 AS n, 'kept' AS file FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_orderkey % 3, 'dropped' FROM orders WHERE o_orderstatus = 'F'")
def example_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only examples with entries are written; dropped ones go to a file of their own."""
    n = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), n.cast("int")).alias("found"), n.alias("n"), F.when(F.col("o_orderstatus") == "F", "some_reason").alias("drop_reason"))
    kept, dropped = tables.scratch(spark, "examples"), tables.scratch(spark, "dropped")
    tables.write_examples(rows, kept, ["found"])
    tables.write_dropped(rows, dropped)
    read = lambda path, file: spark.read.schema("id long, n long").json(path).withColumn("file", F.lit(file))
    return tables.kept(read(kept, "kept").unionByName(read(dropped, "dropped")), kept, dropped)


@query("SELECT 'facts' AS name, count(*) AS n, count(DISTINCT o_custkey) AS n_keys, sum(length(o_orderkey::VARCHAR || ', \"' || o_orderpriority || '\" }]'))::BIGINT AS n_chars FROM orders UNION ALL SELECT 'labels', 2 * count(*), count(*), sum(2 * length(c_name))::BIGINT FROM customer UNION ALL SELECT 'conversions', 3 * count(*), count(*), sum(3 * length(r_name) + 3)::BIGINT FROM region")
def knowledge_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document of a statement for each order by customer, labels by kind and conversions by unit, read as
    tables in byte ranges of its one file. Entities hold commas, quotes and brackets."""
    entity = F.concat(F.col("o_orderkey").cast("string"), F.lit(', "'), F.col("o_orderpriority"), F.lit('" }]'))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.struct(entity.alias("entity"), F.lit("P1").alias("property"), F.col("o_totalprice").cast("string").alias("value"), F.lit("U0").alias("unit")).alias("f"))
    entry = lambda key, value: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(": "), F.to_json(value), F.lit(","))
    facts = o.groupBy("page").agg(F.collect_list("f").alias("f")).select(F.lit(1).alias("part"), entry(F.col("page").cast("string"), F.col("f")).alias("line"))
    labels = table(spark, sf_dir, "customer").select(F.lit(3).alias("part"), entry(F.col("c_name"), F.array("c_name", F.lower("c_name"))).alias("line"))
    to = F.array(*[F.struct(F.concat(F.col("r_name"), F.lit(f"{k}")).alias("to_unit"), F.lit("1").alias("conv_factor_numerator"), F.lit(str(k + 1)).alias("conv_factor_denominator")) for k in range(3)])
    conversions = table(spark, sf_dir, "region").select(F.lit(5).alias("part"), entry(F.col("r_name"), to).alias("line"))
    around = values(spark, """(0, '{"quantitative_statements": {'), (2, '"0": []}, "labels": {"units": {'), (4, '"none": []}}, "unit_conversion_data": {'), (6, '"none": []}}')""", "part, line")
    path = tables.scratch(spark, "bundle")
    # One file has one writer, which holds a row for each entry, not the document.
    facts.unionByName(labels).unionByName(conversions).unionByName(around).repartition(1).sortWithinPartitions("part").select("line").write.text(path)
    known = tables.read_knowledge_json(spark, path)
    count = lambda name, key, text: known[name].agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), F.sum(F.length(text)).alias("n_chars")).select(F.lit({"unit_conversions": "conversions"}.get(name, name)).alias("name"), "*")
    totals = tables.knowledge_totals(known["facts"]).select(F.lit("facts").alias("name"), F.col("n_facts").alias("n"), F.col("n_pages").alias("n_keys"))
    # Both sides are one row.
    facts_row = totals.join(known["facts"].agg(F.sum(F.length("entity")).alias("n_chars")), F.lit(True))
    found = facts_row.unionByName(count("labels", "uri", "alias")).unionByName(count("unit_conversions", "from_unit", "to_unit"))
    return tables.kept(found, path)


@query("WITH b AS (SELECT s_nationkey, s_suppkey, length('{\"item\": {\"value\": \"S' || s_suppkey || '\"}, \"name\": {\"value\": \"x\"}}') AS size FROM supplier), e AS (SELECT s_nationkey, s_suppkey, sum(size + 2) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 2 + length('{\"head\": {}, \"results\": {\"bindings\": [') AS until, length('{\"head\": {}, \"results\": {\"bindings\": [') + (SELECT sum(size + 2) - 2 FROM b c WHERE c.s_nationkey = e.s_nationkey) AS whole FROM b e) SELECT s_nationkey, 'S' || s_suppkey AS item, 'x' AS name FROM e WHERE s_nationkey % 2 = 0 OR until <= whole - 60")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which every second was cut off: what is whole of them is read."""
    ship(spark)
    row = F.concat(F.lit('{"item": {"value": "S'), F.col("s_suppkey").cast("string"), F.lit('"}, "name": {"value": "x"}}'))
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), ", ").alias("t"))
    text = F.concat(F.lit('{"head": {}, "results": {"bindings": ['), F.col("t"))
    text = F.when(F.col("s_nationkey") % 2 == 0, F.concat(text, F.lit("]}}"))).otherwise(F.substring(text, F.lit(1), F.length(text) - 60))
    return endpoint.bindings_of(rows.select("s_nationkey", text.alias("t")), "t", ["item", "name"])


@query("SELECT n_name AS key, c_custkey % 3 AS page, c_name AS item, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS label, CAST(NULL AS VARCHAR) AS error FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_nationkey % 4 = 0 AND c_custkey % 3 = 2) UNION ALL SELECT DISTINCT n_name, c_custkey % 3, NULL, NULL, 'HTTPError: 503' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 = 0 AND c_custkey % 3 = 2")
def endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept answers of an endpoint in pages for each nation; every fourth nation's last page failed. A variable that
    isn't bound is null."""
    ship(spark)
    label = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_mktsegment").alias("value")))
    binding = F.struct(F.struct(F.col("c_name").alias("value")).alias("item"), label.alias("label"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = rows.groupBy(F.col("n_name").alias("key"), (F.col("c_custkey") % 3).cast("int").alias("page"), "n_nationkey").agg(F.collect_list(binding).alias("b"))
    broken = (F.col("n_nationkey") % 4 == 0) & (F.col("page") == 2)
    answer = F.to_json(F.struct(F.struct(F.col("b").alias("bindings")).alias("results")))
    path = tables.scratch(spark, "answers")
    endpoint.keep_answers(found.select("key", "page", F.when(~broken, answer).alias("answer"), F.when(broken, "HTTPError: 503").alias("error")), path)
    return tables.kept(endpoint.stored(spark, path, ["item", "label"]), path)


class NumberedPages:
    """A page service whose titles end in their page's number; every third call of fifty is refused, every fourth page is
    outside the article namespace, and the page after each of these doesn't exist."""

    def __call__(self, address: str) -> str:
        titles = parse_qs(urlsplit(address).query)["titles"][0].split("|")
        numbers = [int(t.rsplit("#", 1)[1]) for t in titles]
        if numbers[0] // 50 % 3 == 2:
            raise OSError("busy")
        pages = {str(n): {"ns": int(n % 4 == 0), "title": t} | ({} if n % 4 == 1 else {"pageid": n + 7}) for n, t in zip(numbers, titles, strict=True)}
        return json.dumps({"query": {"pages": pages}})


@query("WITH n AS (SELECT c_name AS title, c_custkey AS k, (row_number() OVER (ORDER BY c_name) - 1) // 50 AS call FROM customer), r AS (SELECT title, k, CASE WHEN min(k) OVER (PARTITION BY call) // 50 % 3 = 2 THEN 'OSError: busy' WHEN k % 4 = 0 THEN 'wrong_namespace' WHEN k % 4 = 1 THEN 'no_page_id_for_given_title' END AS reason FROM n) SELECT title, CASE WHEN reason IS NULL THEN k + 7 END AS page_id, reason FROM r UNION ALL SELECT NULL, NULL, 'no_page_id_for_given_title'")
def page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids of all customers' names and of a null title by calls of fifty titles each, of which every third fails."""
    ship(spark)
    titles = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"))
    nameless = spark.range(1).select(F.lit(None).cast("string").alias("title"))
    good, failed = endpoint.page_mappings(titles.unionByName(nameless), NumberedPages(), attempts=1)
    return good.select("title", "page_id", F.lit(None).cast("string").alias("reason")).unionByName(failed.select("title", F.lit(None).cast("long").alias("page_id"), "reason"))


@query("SELECT c_name AS title, CASE WHEN c_custkey % 4 <> 1 THEN c_custkey + 7 END AS page_id, CASE WHEN c_custkey % 4 = 0 THEN 'wrong_namespace' WHEN c_custkey % 4 = 1 THEN 'no_page_id_for_given_title' END AS reason FROM customer")
def page_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids from stored answers of the page service, fifty titles each, through normalisation and redirects."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.floor(F.col("c_custkey") / 50).alias("call"))
    final = F.when(F.col("k") % 3 == 0, F.concat(F.lit("End "), F.col("k").cast("string"))).otherwise(F.col("title"))
    moved = F.collect_list(F.when(F.col("k") % 3 == 0, F.struct(F.col("title").alias("from"), final.alias("to"))))
    page = F.struct(F.when(F.col("k") % 4 != 1, F.col("k") + 7).alias("pageid"), F.when(F.col("k") % 4 == 0, 1).otherwise(0).alias("ns"), final.alias("title"))
    pages = F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), page)))
    answers = c.groupBy("call").agg(F.to_json(F.struct(F.struct(F.array().cast("array<struct<from:string,to:string>>").alias("normalized"), moved.alias("redirects"), pages.alias("pages")).alias("query"))).alias("json"))
    good, failed = endpoint.page_info(answers.select("json"), c.select("title"))
    return good.select("title", "page_id", F.lit(None).cast("string").alias("reason")).unionByName(failed.select("title", "page_id", "reason"))


@query("SELECT * FROM (VALUES ('en', 6571321, 4185916131), ('simple', 220357, 48570822)) AS t(language, articles, words)")
def site_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, *(dump.statistics(k)[c] for c in ("articles", "words"))) for k in ("en", "simple")]
    return spark.createDataFrame(rows, "language string, articles long, words long")


@query("WITH c AS (SELECT p_brand AS qid, count(*) AS n FROM part GROUP BY p_brand), r AS (SELECT qid, n, row_number() OVER (ORDER BY n DESC, qid) AS rank, count(*) OVER () AS total FROM c) SELECT 'full_text' AS mode, qid, n FROM r WHERE rank <= floor(total / 2)")
def stored_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit frequencies as they are written, read and cut to the more frequent half."""
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("qid")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("full_text").alias("mode"), "qid", "n")
    path = tables.scratch(spark, "frequencies")
    counted.write.parquet(path)
    read = tables.read_frequencies(spark, path)
    return tables.kept(frequency.top(read.select("qid", "n")).select(F.lit("full_text").alias("mode"), "qid", "n"), path)


@query("SELECT doc_id AS id FROM (SELECT doc_id FROM documents WHERE doc_id % 3 > 0 ORDER BY doc_id LIMIT 25) UNION ALL SELECT doc_id FROM documents")
def analysed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 pages with quantities, as a limit asks for, and all pages where there is none."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("quantities"))
    return frequency.pages_to_analyse(pages, 25, quantities_only=True).select("id").unionByName(frequency.pages_to_analyse(pages).select("id"))


# --- Jobs ------------------------------------------------------------------------------------------------------------

_PART_PAGE = "concat('{{Infobox part|size=1}}The ''''''', p_name, ' ', {n}, ''''''' is a part. It is {{convert|', p_size + 10, '|km|mi|0}} long and made of [[iron]]. It was made ', CASE WHEN p_size % 2 = 0 THEN 'twice ' ELSE 'well ' END, 'for {{cvt|', p_size + 20, '|kg|lb|0}} in all.<!-- x -->\\n\\n== A heading of the page ==')"
def _hash(seed: str, place: str) -> str:
    """SQL for the number below 1000 that decides how a quantity is shown."""
    return f"('0x' || substr(md5({seed} || ':' || {place}), 1, 8))::BIGINT % 1000"


def _shown(seed: str, place: int, left: str, right: str, both: str) -> str:
    return f"CASE WHEN {_hash(seed, str(place))} < 475 THEN {left} WHEN {_hash(seed, str(place))} < 950 THEN {right} ELSE {both} END"


_KM, _MI = "(p_size + 10)", "CAST(round((p_size + 10) * 1000 / 1609.344) AS BIGINT)"
_KG, _LB = "(p_size + 20)", "CAST(round((p_size + 20) * 1000 / 453.59237) AS BIGINT)"
_FIRST = _shown("p_partkey", 0, f"concat({_KM}, ' kilometres')", f"concat({_MI}, ' mi')", f"concat({_KM}, ' kilometres (', {_MI}, ' mi)')")
_SECOND = _shown("p_partkey", 1, f"concat({_KG}, ' kg')", f"concat({_LB}, ' lb')", f"concat({_KG}, ' kg (', {_LB}, ' lb)')")
_HOW = "CASE WHEN p_size % 2 = 0 THEN 'twice ' ELSE 'well ' END"


@query(f"""WITH s AS (SELECT p_partkey AS id, 'It is ' AS head, {_FIRST} AS value, ' long and made of iron.' AS tail FROM part
  UNION ALL SELECT p_partkey, concat('It was made ', {_HOW}, 'for '), {_SECOND}, ' in all.' FROM part
  UNION ALL SELECT -p_partkey - 1, 'It is ', {_shown('-p_partkey - 1', 2, "p_size || ' m'", "p_size || ' yd'", "p_size || ' m (' || p_size || ' yd)'")}, ' long and made of wood.' FROM part
  UNION ALL SELECT -p_partkey - 1, '', p_size || ' m (' || p_size || ' yd)', '' FROM part WHERE {_hash('-p_partkey - 1', '1')} >= 950)
SELECT id, head || value || tail AS sentence, value, length(head)::INTEGER AS start, 1 AS n, CASE WHEN head = '' THEN 'little_text' END AS reason FROM s""")
def quantity_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles for all parts through the parse and the quantity job, and parsed pages with a heading and a quantity that
    stands alone, which has the three words of a sentence only where both sides are shown."""
    raw = made(spark, sf_dir, "part", id="p_partkey", title="p_name", text=_PART_PAGE.replace("{n}", letters("p_partkey")))
    # Dealt out while rows are short: the jobs themselves shuffle nothing, and a small table is one task otherwise.
    cores = spark.sparkContext.defaultParallelism
    pages = parse.converted_pages(raw.repartition(cores, "id"))
    size = F.col("p_size").cast("string")
    q = F.array(F.concat(size, F.lit(" m")), F.concat(size, F.lit(" yd")), F.concat(size, F.lit(" m ("), size, F.lit(" yd)")))
    runs = F.array(*[F.array(F.lit(t)) for t in ("## The size of it is ", "\n\n", "\n\nIt is ", " long and made of wood.")])
    own = table(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("title"), runs.alias("text"), F.array(q, q, q).alias("quantities"))
    rows = quantity.examples(pages.unionByName(own.repartition(cores, "id")))
    value = F.get("quantities", F.lit(0))
    return rows.select("id", "sentence", spans.substring(F.col("sentence"), value).alias("value"), value["start"].alias("start"), F.size("quantities").alias("n"), F.col("drop_reason").alias("reason"))


@query(f"SELECT id, place::INTEGER AS place, CASE WHEN h < 475 THEN 'left' || place WHEN h < 950 AND place <> 3 THEN 'right' || place ELSE 'both' || place END AS side FROM (SELECT doc_id AS id, place, {_hash('doc_id', 'place')} AS h FROM documents, range(6) AS r(place))")
def rendered_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that is shown of six quantities for each document; the fourth has no right side, which shows both."""
    sides = lambda k: F.array(F.lit(f"left{k}"), F.lit(None if k == 3 else f"right{k}").cast("string"), F.lit(f"both{k}"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(*map(sides, range(6))).alias("quantities"))
    return pages.select("id", F.posexplode(quantity.rendered(F.col("quantities"), F.col("id"))).alias("place", "side"))


#: Eight kinds of sentences about a supplier: what they state of its height, and what becomes of them.
_TOWER = "concat('Tower ', {n})"
_V = "CAST(3000 + 3 * s_suppkey AS STRING)"
_KINDS = [
    ("concat({t}, ' has a height of ', {v}, ' metres.')", None),
    ("concat({t}, ' had a height of ', {v}, ' metres in 1995.')", None),
    ("concat({t}, ' has ', {v}, ' metres, of which ', {v}, ' metres of height are new.')", "multiple_values"),
    ("concat('All towers there have a height of ', {v}, ' metres.')", "no_measured_entity"),
    ("concat({t}, ' stands there. It has a height of ', {v}, ' metres.')", None),
    ("concat({t}, ' has a height of ', {v}, ' things.')", "no_unit"),
    ("concat({t}, ' has a height, though wide, of ', {v}, ' metres and a wide base.')", "prevent_mixing_up_height_width_and_depth"),
    ("concat({t}, ' rises, of which ', {v}, ' metres of height.')", "of_which_before_value_annotation"),
]


def tower_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A page and a fact for each supplier, with labels and conversions."""
    t, v = _TOWER.replace("{n}", letters("s_suppkey")), _V
    body = "CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN {e.replace('{t}', t).replace('{v}', v)}" for k, (e, _) in enumerate(_KINDS)) + " END"
    rows = made(spark, sf_dir, "supplier", id="s_suppkey", title=t, body=body, v=v)
    pages = rows.select("id", "title", F.array(F.array("body")).alias("text"), F.array().cast("array<array<string>>").alias("quantities"))
    null = F.lit(None).cast("string")
    year = F.struct(F.lit("pq:P585").alias("qualifier"), F.lit("+1995-00-00T00:00:00Z").alias("value"), null.alias("lowerbound"), null.alias("upperbound"), null.alias("unit"), F.lit("9").alias("time_precision"))
    facts = rows.select(F.col("id").alias("page_id"), (F.col("id") * 10).alias("fact_id"), F.concat(F.lit("wd:T"), "id").alias("entity"), F.lit("wdt:P2048").alias("property"), F.col("v").alias("value"), null.alias("value_lowerbound"), null.alias("value_upperbound"), F.lit("Q11573").alias("unit"), F.array(year).alias("qualifiers"), null.alias("article"))
    labels = rows.select(F.lit("entities").alias("kind"), F.concat(F.lit("wd:T"), "id").alias("uri"), F.col("title").alias("alias")).unionByName(values(spark, "('properties', 'wdt:P2048', 'height'), ('units', 'Q11573', 'metre'), ('units', 'Q11573', 'm')", "kind, uri, alias"))
    return pages, facts, labels, values(spark, "('Q11573', 'Q11573', '1', '1')", "from_unit, to_unit, num, den")


_TOWERS = "SELECT s_suppkey AS page_id, [" + ", ".join("NULL" if r is None else f"'{r}'" for _, r in _KINDS) + "][s_suppkey % 8 + 1] AS reason, CASE s_suppkey % 8 WHEN 1 THEN '1995' ELSE '' END AS point_in_time, CASE s_suppkey % 8 WHEN 4 THEN 'It' ELSE 'Tower ' || " + letters("s_suppkey") + " END AS entity, CAST(3000 + 3 * s_suppkey AS VARCHAR) AS value, CASE s_suppkey % 8 WHEN 4 THEN 'found_entity_with_coreference_resolution' ELSE '' END AS doubts FROM supplier"


@query(f"SELECT page_id, reason FROM ({_TOWERS})")
def context_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each supplier's sentence in the context job."""
    return context.examples(*tower_pages(spark, sf_dir)).select("page_id", F.col("drop_reason").alias("reason"))


@query(f"SELECT page_id AS id, entity, value, point_in_time, doubts FROM ({_TOWERS}) WHERE reason IS NULL")
def context_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context dataset over a page for each supplier."""
    found = context.dataset(*tower_pages(spark, sf_dir))
    part = lambda tag: F.coalesce(spans.substring(F.col("sentence"), F.get(F.try_element_at("annotations", F.lit(tag)), F.lit(0))), F.lit(""))
    return found.select("id", part("entity").alias("entity"), part("value").alias("value"), part("point_in_time").alias("point_in_time"), F.array_join("weak_accept_reasons", " ").alias("doubts"))


#: Eight kinds of sentences about a supplier whose facts all have the same qualifiers: what becomes of them, and the
#: qualifiers that they state.
_QUALIFIED = [
    ("concat({t}, ' has a height of ', {v}, ' metres above the old mill.')", None, "location=old mill"),
    ("concat({t}, ' has a height of ', {v}, ' metres without the mast.')", None, "applies_to_part=mast"),
    ("concat({t}, ' at 12.345 and 67.891 has a height of ', {v}, ' metres.')", None, "coordinate_location=12.345 coordinate_location=67.891"),
    ("concat({t}, ' with its storeys has a height of ', {v}, ' metres.')", None, "criterion_used=storeys"),
    ("concat('The height of ', {t}, ' in metres, as it was told, is ', {v}, ' feet.')", "value_adjecent_to_other_unit", ""),
    ("concat({t}, ' has a height of ', {v}, ' metres as number 7 of all.')", None, ""),
    ("concat({t}, ' had a height of ', {v}, ' metres from 1995 to 2001.')", None, "end_time=2001 start_time=1995"),
    ("concat({t}, ' has a height of ', {v}, ' metres and is made of granite.')", None, "some_qualifier=granite"),
]
_FACT_QUALIFIERS = "array(" + ", ".join(
    f"named_struct('qualifier', '{q}', 'value', {v}, 'lowerbound', CAST(NULL AS STRING), 'upperbound', CAST(NULL AS STRING), 'unit', {u}, 'time_precision', {p})"
    for q, v, u, p in (
        ("pq:P276", "'wd:L1'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"), ("pq:P518", "'wd:M1'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
        ("pq:P625", "'Point(67.891 12.345)'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"), ("pq:P1013", "'40'", "'wd:U1'", "CAST(NULL AS STRING)"),
        ("pq:P1352", "'7'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"), ("pq:P580", "'+1995-00-00T00:00:00Z'", "CAST(NULL AS STRING)", "'9'"),
        ("pq:P582", "'+2001-00-00T00:00:00Z'", "CAST(NULL AS STRING)", "'9'"), ("pq:P9999", "'wd:X1'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
    )
) + ")"


@query("SELECT s_suppkey AS page_id, [" + ", ".join("NULL" if r is None else f"'{r}'" for _, r, _ in _QUALIFIED) + "][s_suppkey % 8 + 1] AS reason, [" + ", ".join(f"'{q}'" for _, _, q in _QUALIFIED) + "][s_suppkey % 8 + 1] AS qualifiers FROM supplier")
def qualified_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textual qualifiers, places, periods and rankings of facts in the context job, with the frequent units that the
    unit-frequencies job counts on the same pages."""
    _, facts, labels, _ = tower_pages(spark, sf_dir)
    t, v = _TOWER.replace("{n}", letters("s_suppkey")), _V
    body = "CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN {e.replace('{t}', t).replace('{v}', v)}" for k, (e, _, _) in enumerate(_QUALIFIED)) + " END"
    rows = made(spark, sf_dir, "supplier", id="s_suppkey", title=t, body=body)
    pages = rows.select("id", "title", F.array(F.array("body")).alias("text"), F.array().cast("array<array<string>>").alias("quantities"))
    facts = facts.withColumn("qualifiers", F.expr(_FACT_QUALIFIERS))
    more = "('units', 'Q3710', 'foot'), ('units', 'Q3710', 'feet'), ('qualifiers_values', 'wd:L1', 'old mill'), ('qualifiers_values', 'wd:M1', 'mast'), ('qualifiers_units', 'wd:U1', 'storey'), ('qualifiers_values', 'wd:X1', 'granite')"
    labels = labels.unionByName(values(spark, more, "kind, uri, alias"))
    conversions = values(spark, "('Q11573', 'Q11573', '1', '1'), ('Q3710', 'Q3710', '1', '1')", "from_unit, to_unit, num, den")
    counted, _ = unit_frequencies.count(pages, facts, conversions, labels, statements.stop_words(spark), ("full_text",))
    frequent = frequency.frequent_aliases(frequency.top(counted.select("qid", "n"), 100), labels)
    found = context.examples(pages, facts, labels, conversions, frequent)
    stated = F.map_filter("annotations", lambda tag, _: ~tag.isin("entity", "property", "value", "unit"))
    named = F.flatten(F.transform(F.map_entries(stated), lambda e: F.transform(e["value"], lambda s: F.concat(e["key"], F.lit("="), spans.substring(F.col("sentence"), s)))))
    return found.select("page_id", F.col("drop_reason").alias("reason"), F.array_join(F.array_sort(named), " ").alias("qualifiers"))


@query(f"WITH t AS ({_TOWERS}) SELECT 'context' AS dataset, 'counts' AS category, 'analyzed_pages' AS key, count(*) AS n FROM t UNION ALL SELECT 'context', 'counts', 'candidates', count(*) FROM t UNION ALL SELECT 'context', 'counts', 'number_of_examples', count(*) FROM t WHERE reason IS NULL UNION ALL SELECT 'context', 'dropped_cause', reason, count(*) FROM t WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'context', 'accept_cause', doubts, count(*) FROM t WHERE doubts <> '' GROUP BY doubts")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the passes which write the context dataset take, merged from two runs over half of the pages each."""
    pages, facts, labels, conversions = tower_pages(spark, sf_dir)
    runs = []
    for k in (0, 1):
        seen, path = statistics.Observed("context"), tables.scratch(spark, "context")
        examples = seen.examples(context.examples(seen.pages(pages.where(F.col("id") % 2 == k)), facts, labels, conversions))
        tables.write_json_lines(examples.where("drop_reason IS NULL").drop("drop_reason"), path)
        runs.append(seen.table())
        tables.removed(spark, path)
    return statistics.merged(*runs)


@query("SELECT 'facts' AS dataset, 'counts' AS category, 'before' AS key, count(*) AS n FROM lineitem UNION ALL SELECT 'facts', 'counts', 'after', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def reduction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far grouping reduces statements."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return statistics.reduction(rows, rows.distinct(), "facts")


@query("WITH p AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS text, s_suppkey % 3 = 0 AS stated FROM supplier) SELECT s_suppkey AS id, text, stated FROM p WHERE text OR stated")
def pages_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with quantities or with facts, and which of both."""
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("quantities"))
    facts = pages.where("id % 3 = 0").select(F.col("id").alias("page_id"))
    return context.pages_of_interest(pages, facts).select("id", F.col("has_quantities").alias("text"), F.col("has_facts").alias("stated"))


@query("SELECT mode, unit AS qid, n FROM (SELECT 'full_text' AS mode, 'U1' AS unit, 2 * count(*) FILTER (s_suppkey % 2 = 0) + count(*) FILTER (s_suppkey % 2 = 1) AS n FROM supplier UNION ALL SELECT 'full_text', 'U2', count(*) FILTER (s_suppkey % 2 = 1) FROM supplier UNION ALL SELECT 'quantities', 'U1', count(*) FILTER (s_suppkey % 2 = 0) FROM supplier UNION ALL SELECT 'quantities', 'U2', 0)")
def unit_frequency_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit counts over full texts and over quantities alone, of all pages."""
    body = "CASE WHEN s_suppkey % 2 = 0 THEN 'It has 5 metres and 6 m here.' ELSE 'A metre, a foot.' END"
    rows = made(spark, sf_dir, "supplier", id="s_suppkey", title="s_name", body=body)
    side = F.array(F.lit("5 m"), F.lit("16 ft"), F.lit("5 m (long)"))
    none = F.array().cast("array<array<string>>")
    pages = rows.select("id", "title", F.array(F.array("body")).alias("text"), F.when(F.col("id") % 2 == 0, F.array(side)).otherwise(none).alias("quantities"))
    facts = values(spark, "('U1'), ('U2'), ('U3')", "unit")
    labels = values(spark, "('units', 'U1', 'metre'), ('units', 'U1', 'm'), ('units', 'U2', 'foot')", "kind, uri, alias")
    counted, _ = unit_frequencies.count(pages, facts, values(spark, "('U1', 'U2', '1', '1')", "from_unit, to_unit, num, den"), labels, statements.stop_words(spark))
    return counted
