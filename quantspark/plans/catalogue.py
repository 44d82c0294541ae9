"""Queries by name, each over whole tables, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark.functions import dates, numbers, spans, text, units, vocab
from quantspark.functions.convert import expanded_template
from quantspark.operators import annotate, filters, frequency, graph_patterns, intervals, matching, sequence, statements
from quantspark.operators.paths import nearest_candidates
from quantspark.plans import goldens
from quantspark.plans.registry import ORACLE_SQL, QUERIES, dealt, query, table, values
from quantspark.session import ship
from quantspark.sources import dump

__all__ = ["ORACLE_SQL", "QUERIES", "mini_corpus"]


# --- Sources and row filters -------------------------------------------------------------------------------------

@query("SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS n_chars, length(html) - length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS n_removed FROM pages")
def strip_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rest = F.length(text.without_comments(F.col("html"))).cast("long")
    return pages.select("page_id", rest.alias("n_chars"), (F.length("html") - rest).alias("n_removed"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, user_id FROM events WHERE props IS NOT NULL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("k"), "user_id")


# --- Numbers -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_runs, list_extract(regexp_extract_all(text, '[0-9]+'), 1) AS first_run FROM documents WHERE regexp_matches(text, '[0-9]')")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    runs = numbers.digit_runs(F.col("text"))
    return docs.select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.get(runs, F.lit(0)).alias("first_run"))


@query("SELECT doc_id, count(*) AS n_numbers, min(length(run)) AS shortest, max(length(run)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents) GROUP BY doc_id")
def numbers_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.digit_runs(F.col("text"))).alias("run"))
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.min(F.length("run")).cast("long").alias("shortest"), F.max(F.length("run")).cast("long").alias("longest"))


def literal(value: str | float | None, kind: str = "STRING") -> str:
    """A SQL literal that both engines read."""
    return f"CAST(NULL AS {kind})" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS {kind})"


#: The published cases, and further ones.
_NUMBER_TEXTS = [*goldens.NUMBERS, ("twenty five", 25.0), ("two hundred and five", 205.0), ("three quarters", 0.75), ("1e5", 1e5)]
_NUMBER_TRUTH = ", ".join(f"({literal(t)}, {literal(v, 'DOUBLE')})" for t, v in _NUMBER_TEXTS)


@query(f"SELECT input, value FROM (VALUES {_NUMBER_TRUTH}) AS t(input, value)")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.createDataFrame([(t,) for t, _ in _NUMBER_TEXTS], "input string")
    return rows.select("input", numbers.parse_number(F.col("input")).alias("value"))


@query("SELECT o_orderkey, TRY_CAST(replace(o_text, ',', '') AS DOUBLE) AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS o_text FROM orders)")
def parse_plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", numbers.parse_plain(shown).alias("value"))


_PARTS = [s.split(goldens.VALUE_TAG) for s in goldens.SENTENCES]
_SPAN_TRUTH = ", ".join(f"({literal(''.join(p))}, {len(p) // 2}, {literal(' | '.join(p[1::2]))})" for p in _PARTS)


@query(f"SELECT sentence, n, found FROM (VALUES {_SPAN_TRUTH}) AS t(sentence, n, found)")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published sentences; their tags are read by the decoder."""
    ship(spark)
    rows = spark.createDataFrame([(s,) for s in goldens.SENTENCES], "marked string")
    rows = rows.select(text.decoded_inline(F.col("marked"), F.lit(goldens.VALUE_TAG)).alias("d")).select(F.col("d.text").alias("sentence"))
    found = rows.withColumn("spans", numbers.number_spans("sentence"))
    shown = F.array_join(F.transform("spans", lambda s: spans.substring(F.col("sentence"), s)), " | ")
    return found.select("sentence", F.size("spans").alias("n"), shown.alias("found"))


@query()
def document_number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with values in all documents; rows without a digit or number word don't reach Python's finder for long."""
    ship(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(numbers.number_spans("text")).alias("span"))
    shown = spans.substring(F.col("text"), F.col("span"))
    return found.select("doc_id", F.col("span.start").alias("start"), F.col("span.end").alias("end"), shown.alias("number")).withColumn("value", numbers.parse_number(F.col("number")))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
_CARDINALS = ", ".join(f"('{w}', {n})" for n, w in enumerate(_ONES.split())) + ", ('twenty', 20), ('thirty', 30), ('forty', 40), ('fifty', 50), ('sixty', 60), ('seventy', 70), ('eighty', 80), ('ninety', 90), ('hundred', 100)"


@query(f"SELECT 'cardinal' AS kind, term, CAST(value AS DOUBLE) AS value FROM (VALUES {_CARDINALS}) AS t(term, value)")
def cardinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(spark).where("kind = 'cardinal'").select("kind", "term", "value")


@query("SELECT * FROM (VALUES ('cardinal', 29, true), ('ordinal', 45, true), ('magnitude', 101, true), ('colloquial', 149, false), ('constant', 158, false), ('custom', 4, false)) AS t(kind, n, has_value)")
def number_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocab.vocabulary(spark).where("kind <> 'denominator'")
    return words.groupBy("kind").agg(F.count_distinct("term").cast("int").alias("n"), F.every(F.col("value").isNotNull()).alias("has_value"))


@query("SELECT term, term IN ('first', 'eleventh', 'lots of', 'speed of light', 'pi ', 'third') AS kept FROM (VALUES ('first'), ('eleventh'), ('less'), ('2ndly'), ('lots of'), ('speed of light'), ('pi '), ('third'), ('ringed')) AS t(term)")
def blacklisted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vocabularies as one set, without a literal and without terms that hold digits."""
    asked = values(spark, "('first'), ('eleventh'), ('less'), ('2ndly'), ('lots of'), ('speed of light'), ('pi '), ('third'), ('ringed')", "term")
    return asked.join(vocab.blacklist(vocab.vocabulary(spark)).withColumn("kept", F.lit(True)), "term", "left").select("term", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("SELECT term FROM (VALUES ('zeroth'), ('first'), ('second'), ('hundredth'), ('primary'), ('quaternary')) AS t(term) WHERE term NOT IN ('hundredth') UNION ALL SELECT 'thousandth' WHERE false")
def ordinals_without_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals that are no denominators, of those asked for."""
    left = vocab.basic_number_words("ordinals_minus_denominators")
    return values(spark, "('zeroth'), ('first'), ('second'), ('third'), ('hundredth'), ('primary'), ('quaternary')", "term").where(F.col("term").isin(left))


# --- Text and ordered operators ------------------------------------------------------------------------------------


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(text.sentence_spans("text")).alias("sent_idx", "s"))
    return found.select("doc_id", "sent_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.running_offset(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text").cast("long"), "start").select("conv_id", "turn", "start")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS par_idx, md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS previous, md5(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS after FROM conversations")
def paragraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sequence.paragraphs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    turns = sequence.with_previous(sequence.with_context(turns, ["conv_id"], ["turn"]), ["conv_id"], ["turn"])
    after = F.when(F.size("after") > 0, F.md5(F.array_join("after", "|")))
    return turns.select("conv_id", "turn", "par_idx", F.md5("previous").alias("previous"), after.alias("after"))


@query("WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(a) AS start, max(b) AS \"end\" FROM i GROUP BY user_id, island")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp("ts")
    return spans.merge_span_rows(table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 3600).alias("end")), ["user_id"])


@query("WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events)), p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a FROM events WHERE event_type = (SELECT max(event_type) FROM events)) SELECT count(*) AS n_pairs, count(DISTINCT s.user_id) AS n_users FROM s JOIN p ON s.user_id = p.user_id AND p.a >= s.a AND p.a <= s.a + 86400")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last kind within a day after one of the first kind of the same user."""
    events = table(spark, sf_dir, "events")
    kinds = F.broadcast(events.agg(F.min("event_type").alias("low"), F.max("event_type").alias("high")))
    at = F.unix_timestamp("ts").alias("start")
    outer = events.join(kinds, F.col("event_type") == F.col("low")).select("user_id", at, (at + 86400).alias("end"))
    inner = events.join(kinds, F.col("event_type") == F.col("high")).select("user_id", at, at.alias("end"))
    hit = intervals.pairs(inner, outer, ["user_id"], inside=True)
    return hit.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(F.col("right.user_id")).alias("n_users"))


# --- Joins, grouping and sets of statements --------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderpriority, string_agg(CAST(l_linenumber AS VARCHAR), '|' ORDER BY l_orderkey, l_linenumber) AS lines, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderpriority")
def group_concat_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(lines, "o_orderkey")
    rows = joined.withColumns({"lines": F.col("l_linenumber").cast("string"), "place": F.struct("o_orderkey", "l_linenumber")})
    return statements.concatenated(rows, ["o_custkey", "o_orderpriority"], "lines", order="place").withColumn("n", F.size(F.split("lines", r"\|")).cast("long"))


_PART_LABELS = "SELECT 'wdt:' || replace(p_brand, '#', '') AS property, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM (SELECT p_brand, p_name AS label FROM part UNION ALL SELECT p_brand, p_type FROM part) GROUP BY p_brand"


def part_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as quantity properties, with part names as labels and types as other names."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("wdt:"), F.regexp_replace("p_brand", "#", "")).alias("s"), "p_name", "p_type")
    t = lambda p, o, lang=None: F.struct("s", F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang"))
    return part.select(F.inline(F.array(t("wikibase:propertyType", F.lit("wikibase:Quantity")), t("rdfs:label", F.col("p_name"), "en"), t("skos:altLabel", F.col("p_type"), "en"), t("rdfs:label", F.lit("anders"), "de"))))


@query(_PART_LABELS)
def labels_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_patterns.property_catalogue(part_triples(spark, sf_dir)).select("property", F.array_join("labels", "|").alias("labels"))


@query(f"SELECT property, labels FROM ({_PART_LABELS}) WHERE property IN ('wdt:Brand2', 'wdt:Brand17')")
def chosen_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = values(spark, "('wdt:Brand2'), ('wdt:Brand17'), ('wdt:None')", "item")
    return graph_patterns.property_catalogue(part_triples(spark, sf_dir), only=only).select("property", F.array_join("labels", "|").alias("labels"))


_STOP = ", ".join(f"('{w}')" for w in statements.STOP_WORDS)


@query(f"WITH w AS (SELECT DISTINCT lang AS kind, source AS uri, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS alias FROM documents) SELECT kind, uri, alias FROM w WHERE lower(alias) NOT IN (SELECT * FROM (VALUES {_STOP}) AS s(word))")
def stopword_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("source").alias("uri"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("alias"))
    return statements.clean_labels(words, statements.stop_words(spark))


@query("SELECT n_name, r_name, count(s_suppkey) AS n_suppliers, max(s_acctbal) AS best FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name, r_name")
def optional_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    regions = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("region"), "r_name")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    joined = graph_patterns.optional(graph_patterns.optional(nations, regions), suppliers)
    return joined.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("n_suppliers"), F.max("s_acctbal").alias("best"))


@query("SELECT l_orderkey, l_linenumber, hit_limit FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth, count(*) OVER (PARTITION BY l_orderkey) >= 3 AS hit_limit FROM lineitem) WHERE nth <= 3")
def rows_per_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return graph_patterns.limited(lines, "l_orderkey", [F.col("l_linenumber")], 3)


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def missing_mapping_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = statements.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(missing, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS key, max(o_totalprice) AS value, 'new' AS origin FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey UNION ALL SELECT c_custkey, c_acctbal, 'cached' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit("cached").alias("origin"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value")).withColumn("origin", F.lit("new"))
    return statements.upsert(cached, new, "key")


@query("SELECT c_custkey, CAST(ceil(row_number() OVER (ORDER BY c_custkey) / 250.0) AS INTEGER) AS chunk FROM customer")
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.chunked(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", size=250)


# --- Units, values and qualifiers ------------------------------------------------------------------------------------

@query("SELECT p_partkey, unit, round(value, 6) AS value FROM (SELECT p_partkey, unnest(['Q25267', 'Q11579', 'Q42289']) AS unit, unnest([CAST(p_size AS DOUBLE), p_size + 273.15, p_size * 9.0 / 5 + 32]) AS value FROM part)")
def temperature_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", F.inline(units.temperatures(F.col("p_size").cast("double"), F.lit(units.CELSIUS))))
    return found.select("p_partkey", "unit", F.round("value", 6).alias("value"))


# Amounts with two decimals against targets with one or none, in hundredths: stated value v, target t with ``places``, and
# what both are when rounded half to even to the target's places (to one, where it has none and either lies below 1).
_STATED = "(SELECT c_nationkey AS page_id, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) % 4000 AS v FROM customer)"
_TARGETS = "(SELECT s_nationkey AS page_id, s_suppkey, s_suppkey % 2 AS places, CASE WHEN s_suppkey % 2 = 0 THEN CAST(trunc(round(s_acctbal * 100) / 100) AS BIGINT) % 40 * 100 ELSE CAST(trunc(round(s_acctbal * 100) / 10) AS BIGINT) % 400 * 10 END AS t, s_suppkey % 7 = 0 AS bounded FROM supplier)"


def _half_even(x: str, step: str) -> str:
    return f"(sign({x}) * (CASE WHEN abs({x}) % {step} * 2 > {step} OR (abs({x}) % {step} * 2 = {step} AND (abs({x}) // {step}) % 2 = 1) THEN abs({x}) // {step} + 1 ELSE abs({x}) // {step} END) * {step})"


_MATCHES = f"""WITH p AS (
  SELECT c_custkey, s_suppkey, v, t, bounded AND v BETWEEN t - 150 AND t + 250 AS inside,
    CASE WHEN places = 0 AND abs(t) >= 100 AND abs(v) >= 100 THEN 100 ELSE 10 END AS step
  FROM {_STATED} s JOIN {_TARGETS} t USING (page_id)
), q AS (
  SELECT *, abs(v / 100.0::DOUBLE - t / 100.0::DOUBLE) / greatest(abs(t / 100.0::DOUBLE), 2.220446049250313e-16) AS error,
    CASE WHEN v % 10 = 0 AND v % 100 <> 0 THEN 1 WHEN v % 100 = 0 THEN 1 ELSE 2 END AS v_places, {_half_even('v', 'step')} AS rv, {_half_even('t', 'step')} AS rt FROM p
), m AS (
  SELECT c_custkey, s_suppkey, inside, NOT inside AND error > 0.03 AND abs(t) < 100 * 0.5 / 0.03 AND v_places <> (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END)
    AND abs(rv - rt) / greatest(abs(rt), 2.220446049250313e-14) <= 0.03 AS by_rounding, error, v, t, rv, rt FROM q
)"""


def stated_and_targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Account balances of customers as stated numbers and of suppliers as targets: all of them, small ones too, a seventh with bounds."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    stated = dealt(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_custkey")
    stated = stated.select(F.col("c_nationkey").alias("page_id"), "c_custkey", ((cents("c_acctbal") % 4000) / 100).alias("value"))
    stated = stated.withColumn("text", F.col("value").cast("string"))
    s = table(spark, sf_dir, "supplier").withColumn("even", F.col("s_suppkey") % 2 == 0)
    whole = (cents("s_acctbal") / 100).cast("long") % 40
    tenths = (cents("s_acctbal") / 10).cast("long") % 400
    s = s.withColumns({"target": F.when(F.col("even"), whole.cast("double")).otherwise(tenths / 10), "target_text": F.when(F.col("even"), whole.cast("string")).otherwise((tenths / 10).cast("string"))})
    # Whole tenths, divided last: 1.3 - 1.5 as doubles lies above -0.2.
    bound = lambda d: F.when(F.col("s_suppkey") % 7 == 0, (F.when(F.col("even"), whole * 10).otherwise(tenths) + d) / 10)
    return stated, s.select(F.col("s_nationkey").alias("page_id"), "s_suppkey", "target", "target_text", bound(-15).alias("low"), bound(25).alias("high"))


@query(f"{_MATCHES} SELECT c_custkey, s_suppkey, by_rounding, inside FROM m WHERE inside OR error <= 0.03 OR by_rounding")
def value_match_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return matching.value_matches(*stated_and_targets(spark, sf_dir), ["page_id"]).select("c_custkey", "s_suppkey", "by_rounding", "inside")


@query(f"{_MATCHES}, a AS (SELECT *, inside OR v = t OR (by_rounding AND rv = rt) AS exact FROM m WHERE inside OR error <= 0.03 OR by_rounding) SELECT s_suppkey, CASE WHEN count(*) = 1 OR (count(*) FILTER (exact) = 1 AND s_suppkey % 3 > 0) THEN NULL ELSE 'multiple_values' END AS drop_reason, count(*) AS n, count(*) FILTER (exact) AS n_exact FROM a GROUP BY s_suppkey")
def unique_exact_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose number is a multiple of three have no unit, so that an exact value among several does not help them."""
    ship(spark)
    matches = matching.value_matches(*stated_and_targets(spark, sf_dir), ["page_id"]).select("s_suppkey", "c_custkey", "deviation")
    own = Window.partitionBy("s_suppkey")
    counted = matches.withColumns({"n": F.count(F.lit(1)).over(own), "n_exact": F.count_if(F.col("deviation") == 0).over(own)})
    return matching.unique_values(counted, ["s_suppkey"], F.col("s_suppkey") % 3 > 0).select("s_suppkey", "drop_reason", "n", "n_exact")


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) = TIMESTAMP '1995-03-01' AS in_month, date_trunc('year', o_orderdate) = TIMESTAMP '1995-01-01' AS in_year FROM orders")
def date_precision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    known = dates.parse_known(F.lit("+1995-03-00T00:00:00Z"))
    same = lambda p: dates.same_date(known, F.lit(p), at, F.lit("second"))
    return table(spark, sf_dir, "orders").select("o_orderkey", same("month").alias("in_month"), same("year").alias("in_year"))


# --- Frequencies and phrases -----------------------------------------------------------------------------------------

_PHRASES = "('U1', 'the'), ('U1', 'of the'), ('U2', 'and'), ('U3', 'nothing like this'), ('U4', 'is the'), ('U5', 'rings'), ('U6', 'des'), ('U6', 'la')"
#: The lemma of a lower-case word in SQL.
LEMMA_SQL = """CASE w WHEN 'feet' THEN 'foot' WHEN 'men' THEN 'man' WHEN 'women' THEN 'woman' WHEN 'people' THEN 'person' WHEN 'children' THEN 'child' WHEN 'inches' THEN 'inch'
  WHEN 'was' THEN 'be' WHEN 'were' THEN 'be' WHEN 'is' THEN 'be' WHEN 'are' THEN 'be' WHEN 'has' THEN 'have' WHEN 'had' THEN 'have' ELSE
  CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(ss|x|ch|sh)es$') THEN left(w, length(w) - 2)
  WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END END"""
_LEMMAS = f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1) AS i FROM documents), l AS (SELECT doc_id, i, {LEMMA_SQL} AS lemma FROM e)"


@query(f"{_LEMMAS} SELECT doc_id, count(*) AS n_words, count(DISTINCT lemma) AS n_lemmas, md5(string_agg(lemma, ' ' ORDER BY i)) AS lemmas FROM l GROUP BY doc_id")
def word_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(annotate.lemmas(F.col("text")))).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_lemmas"), F.md5(F.array_join("w", " ")).alias("lemmas"))


@query(f"{_LEMMAS}, g AS (SELECT lemma AS phrase FROM l UNION ALL SELECT lemma || ' ' || lead(lemma) OVER (PARTITION BY doc_id ORDER BY i) FROM l), c AS (SELECT id, count(*) AS n FROM g JOIN (VALUES ('U4', 'be the'), ('U5', 'ring'), ('U6', 'des'), ('U6', 'la'), ('U1', 'of the')) AS p(id, phrase) USING (phrase) GROUP BY id) SELECT u.id AS qid, coalesce(c.n, 0) AS n FROM (VALUES ('U1'), ('U3'), ('U4'), ('U5'), ('U6')) AS u(id) LEFT JOIN c USING (id)")
def unit_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; of U1 only the alias that isn't a stop word counts, and U2 has no other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    phrases = values(spark, _PHRASES, "id, phrase")
    labels = phrases.select(F.lit("units").alias("kind"), F.col("id").alias("uri"), F.col("phrase").alias("alias"))
    return frequency.unit_frequencies(docs, ["doc_id"], phrases.select(F.col("id").alias("qid")).distinct(), labels, statements.stop_words(spark))


@query("SELECT p_type AS qid, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY p_type")
def ranked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("qid")).agg(F.count(F.lit(1)).alias("n"))
    return frequency.ranked(counted).withColumn("rank", F.col("rank").cast("long"))


@query("WITH c AS (SELECT p_brand AS qid, count(*) FILTER (p_size > 45) AS n FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, qid) AS rank, count(*) OVER () AS total FROM c WHERE n > 0) SELECT qid, n FROM r WHERE rank <= floor(total * 50 / 100.0)")
def top_half_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("qid")).agg(F.count_if(F.col("p_size") > 45).alias("n"))
    return frequency.top(counted)


@query("SELECT count(*) AS n_pages, count(*) FILTER (n > 0) AS n_with_quantities FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents)")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.page_totals(table(spark, sf_dir, "documents").select("doc_id", numbers.digit_runs(F.col("text")).alias("quantities")))


# --- Filters ---------------------------------------------------------------------------------------------------------

@query("SELECT 'quantity' AS dataset, 'dropped' AS category, CASE WHEN n_chars < 200 THEN 'little_text' WHEN regexp_matches(text, '[0-9]') THEN 'other_number' END AS key, count(*) AS n FROM documents WHERE n_chars < 200 OR regexp_matches(text, '[0-9]') GROUP BY key")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("reason", F.when(F.col("n_chars") < 200, "little_text").when(F.col("text").rlike("[0-9]"), "other_number"))
    return filters.merged_counts(filters.reason_counts(docs, "quantity", "dropped", "reason"))


_HEADS = "(1, array(1, 1, 3, 1), array(array(0), array(2)), array(3)), (2, array(1, 1, 1, 2), array(array(0), array(3)), array(1)), (3, array(1, 1, 1), array(array(0), array(2)), array(1))"


@query("SELECT id, found FROM (VALUES (1, '1'), (2, '0'), (3, '0,1')) AS t(id, found)")
def shortest_tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = values(spark, _HEADS, "id, heads, candidates, target")
    return rows.select("id", F.array_join(nearest_candidates("heads", "candidates", "target"), ",").alias("found"))


# --- Conversion templates --------------------------------------------------------------------------------------------

@query("SELECT template, full_text FROM (VALUES " + ", ".join(f"({literal(t)}, {literal(e)})" for t, e in goldens.TEMPLATES) + ", ('{{convert|NNN|m}}', NULL), ('{{convert|some|m}}', NULL)) AS t(template, full_text)")
def conversion_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published templates, and two that hold no number."""
    ship(spark)
    rows = spark.createDataFrame([(t,) for t, _ in goldens.TEMPLATES] + [("{{convert|NNN|m}}",), ("{{convert|some|m}}",)], "template string")
    return rows.select("template", F.get(expanded_template("template"), F.lit(2)).alias("full_text"))


# --- Whole jobs over a small corpus ----------------------------------------------------------------------------------

_FACTS = "(1, 11, 'wd:Q243', 'wdt:P2048', '324', 'Q11573', CAST(NULL AS STRING), CAST(NULL AS STRING)), (1, 12, 'wd:Q243', 'wdt:P2048', '312', 'Q11573', 'pq:P585', '1889-00-00T00:00:00Z')"
_LABELS = "('entities', 'wd:Q243', 'Iron Tower'), ('properties', 'wdt:P2048', 'height'), ('units', 'Q11573', 'metre'), ('units', 'Q11573', 'm'), ('units', 'Q3710', 'ft'), ('units', 'Q3710', 'foot')"
_SENTENCES_OF_TOWER = "The Iron Tower has a height of 324 metres. It opened long ago. The Iron Tower had a height of 312 m in 1889. The old tower cost money and 1,063 ft is the height of the Iron Tower."


def mini_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, facts, labels and conversions of a corpus of one tower."""
    none = F.array().cast("array<array<string>>")
    pages = values(spark, f"(1L, 'Iron Tower', '{_SENTENCES_OF_TOWER}'), (2L, 'Other', 'Nothing is measured on this page.')", "id, title, body")
    pages = pages.select("id", "title", F.array(F.array("body")).alias("text"), none.alias("quantities"))
    facts = values(spark, _FACTS, "page_id, fact_id, entity, property, value, unit, q, qv")
    null = F.lit(None).cast("string")
    qualifier = F.struct(F.col("q").alias("qualifier"), F.col("qv").alias("value"), null.alias("lowerbound"), null.alias("upperbound"), null.alias("unit"), F.lit("9").alias("time_precision"))
    facts = facts.select(F.col("page_id").cast("long").alias("page_id"), F.col("fact_id").cast("long").alias("fact_id"), "entity", "property", "value", null.alias("value_lowerbound"), null.alias("value_upperbound"), "unit", F.filter(F.array(F.when(F.col("q").isNotNull(), qualifier)), lambda x: x.isNotNull()).alias("qualifiers"), null.alias("article"))
    labels = values(spark, _LABELS, "kind, uri, alias")
    return pages, facts, labels, values(spark, "('Q11573', 'Q11573', '1', '1'), ('Q11573', 'Q3710', '1', '0.3048')", "from_unit, to_unit, num, den")


@query("SELECT s_suppkey AS page_id, 'wd:S' || s_suppkey AS entity, 'wdt:P1' AS property, CAST(s_acctbal AS VARCHAR) AS value, 'Q1' AS unit FROM supplier")
def knowledge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples made of nations and suppliers, as quantitative statements, through the whole knowledge job."""
    from quantspark.plans import knowledge

    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("wd:S"), "s_suppkey").alias("e"), F.concat(F.lit("n"), "s_suppkey").alias("n"), F.concat(F.lit("st"), "s_suppkey").alias("st"), F.col("s_acctbal").cast("string").alias("v"), F.concat(F.lit("w/S"), "s_suppkey").alias("article"), F.col("s_name").alias("name"))
    t = lambda s, p, o, lang=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("o_lang"))
    triples = supplier.select(F.inline(F.array(t(F.col("e"), "p:P1", F.col("st")), t(F.col("st"), "psv:P1", F.col("n")), t(F.col("n"), "wikibase:quantityAmount", F.col("v")), t(F.col("n"), "wikibase:quantityUnit", F.lit("Q1")), t(F.col("article"), "schema:about", F.col("e")), t(F.col("e"), "rdfs:label", F.col("name"), "en"))))
    schema = values(spark, "('wdt:P1', 'wikibase:propertyType', 'wikibase:Quantity', NULL), ('wdt:P1', 'wikibase:claim', 'p:P1', NULL), ('wdt:P1', 'wikibase:statementValue', 'psv:P1', NULL), ('wdt:P1', 'rdfs:label', 'balance', 'en'), ('Q1', 'rdfs:label', 'dollar', 'en')", "s, p, o, o_lang")
    page_map = supplier.select(F.col("article").alias("url"), F.regexp_extract("article", r"(\d+)$", 1).cast("long").alias("page_id"))
    config = values(spark, "('Q1', CAST(NULL AS STRING), CAST(NULL AS STRING))", "qid, si_label, factor")
    return knowledge.build(triples.unionByName(schema), page_map, config, statements.stop_words(spark))["facts"].select("page_id", "entity", "property", "value", "unit")


from quantspark.plans import catalogue_graph, catalogue_jobs, catalogue_orders, catalogue_spans, catalogue_sql, catalogue_text  # noqa: E402, F401  they register their queries
