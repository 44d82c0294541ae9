"""Queries of text, number and annotation functions over sentences made of the tables' rows.

A sentence is put together from columns, so SQL knows where its numbers, names and clauses are; the engine has to find them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions import formats, numbers, spans, text
from quantspark.functions.convert import expanded_template
from quantspark.operators import annotate, filters, matching, phrases
from quantspark.plans.registry import dealt, letters, made, query, table
from quantspark.session import ship

# --- Numbers ---------------------------------------------------------------------------------------------------------

#: Five kinds of sentences with one number of interest, between a start and an end.
_NAME = letters("o_orderkey")
_STARTS = ["'The river of ' || {n} || ' is '", "'Until 1964 the load of ' || {n} || ' was '", "'On April 1, 1995 the firm ' || {n} || ' sold '", "'In 2001 it (' || {n} || ') held about '", "'The third part of ' || {n} || ' has '"]
_VALUES = ["CAST(o_orderkey + 10 AS STRING)", "CAST(o_orderkey % 1000 + 10 AS STRING) || '.5'", "CAST(o_orderkey % 900 + 100 AS STRING) || ',250'", "CAST(o_orderkey % 90 + 10 AS STRING) || ' million'", "'twenty-five'"]
_ENDS = ["' km long.'", "' kg per day.'", "' parcels in all.'", "' units (see above).'", "' wheels.'"]


def _case(parts: list[str]) -> str:
    return "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN {p.replace('{n}', _NAME)}" for k, p in enumerate(parts)) + " END"


_SENTENCE = f"concat({_case(_STARTS)}, {_case(_VALUES)}, {_case(_ENDS)})"
_NUMBER = "CASE o_orderkey % 5 WHEN 0 THEN o_orderkey + 10 WHEN 1 THEN o_orderkey % 1000 + 10.5 WHEN 2 THEN (o_orderkey % 900 + 100) * 1000 + 250 WHEN 3 THEN (o_orderkey % 90 + 10) * 1000000 ELSE 25 END"


def order_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "orders", o_orderkey="o_orderkey", sentence=_SENTENCE)


@query(f"SELECT o_orderkey, length({_case(_STARTS)})::INTEGER AS start, {_case(_VALUES)} AS number, CAST({_NUMBER} AS DOUBLE) AS value FROM orders")
def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each sentence: no date, year or ordinal, in digits, grouped, with a magnitude, or in words."""
    ship(spark)
    rows = order_sentences(spark, sf_dir).select("o_orderkey", "sentence", F.explode(numbers.number_spans("sentence")).alias("s"))
    rows = rows.withColumn("s", spans.trimmed(F.col("sentence"), F.col("s")))
    rows = rows.select("o_orderkey", F.col("s.start").alias("start"), spans.substring(F.col("sentence"), F.col("s")).alias("number"))
    return rows.withColumn("value", numbers.parse_number(F.col("number")))


@query(f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN '1964' WHEN 2 THEN 'April 1, 1995' WHEN 3 THEN '2001' END AS found FROM (SELECT *, {_SENTENCE} AS s FROM orders) WHERE o_orderkey % 5 BETWEEN 1 AND 3")
def sentence_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = order_sentences(spark, sf_dir).select("o_orderkey", "sentence", F.explode(numbers.date_spans("sentence")).alias("s"))
    return rows.select("o_orderkey", spans.substring(F.col("sentence"), F.col("s")).alias("found"))


@query(f"SELECT o_orderkey, concat({_case(_STARTS)}, '<', {_case(_VALUES)}, '<', {_case(_ENDS)}) AS marked FROM orders")
def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline rendering of spans."""
    ship(spark)
    rows = order_sentences(spark, sf_dir)
    return rows.select("o_orderkey", spans.mark(F.col("sentence"), numbers.number_spans("sentence"), "<").alias("marked"))


@query(f"SELECT o_orderkey, {_SENTENCE} AS plain, length({_case(_STARTS)})::INTEGER AS start FROM orders")
def decoded_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", marked=f"concat({_case(_STARTS)}, '@', {_case(_VALUES)}, '@', {_case(_ENDS)})")
    rows = rows.select("o_orderkey", text.decoded_inline(F.col("marked"), F.lit("@")).alias("d"))
    return rows.select("o_orderkey", F.col("d.text").alias("plain"), F.get("d.spans", F.lit(0))["start"].alias("start"))


_NOTATIONS = ["CAST(p_partkey AS STRING) || ' 3/4'", "CAST(p_partkey AS STRING) || '*10^3'", "CAST(p_partkey AS STRING) || ' 10²'", "CAST(p_partkey AS STRING) || ' thousand'", "CAST(p_size AS STRING) || ' + 1/2'", "'-' || CAST(p_partkey AS STRING) || '.25'", "CAST(p_size AS STRING) || ' and a half'", "CAST(p_partkey AS STRING) || ' zorps'"]
_MEANT = ["p_partkey + 0.75", "p_partkey * 1000", "p_partkey * 100", "p_partkey * 1000", "p_size + 0.5", "-(p_partkey + 0.25)", "p_size + 0.5", "NULL"]


@query("SELECT p_partkey, CAST(CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_MEANT)) + " END AS DOUBLE) AS value FROM part")
def number_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, powers, superscripts, magnitudes and words; the last notation is no number."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(_NOTATIONS)) + " END")
    return rows.select("p_partkey", numbers.parse_number(F.col("t")).alias("value"))


@query("SELECT p_partkey, concat(p_partkey, ' ', p_size, ' m') AS spaced FROM part")
def normalised_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superscript digits in their plain form, with a space before and after the run."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat(p_partkey, translate(CAST(p_size AS STRING), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹'), 'm')")
    return rows.select("p_partkey", numbers.nfkc_digits("t").alias("spaced"))


_WORDS20 = "['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_NTH20 = "['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth']"
_TENS = "['', 'twenty','thirty','forty','fifty']"


@query(f"WITH w AS (SELECT p_partkey, p_size AS n, CASE WHEN p_size < 20 THEN {_WORDS20}[p_size] WHEN p_size % 10 = 0 THEN {_TENS}[p_size // 10] ELSE {_TENS}[p_size // 10] || '-' || {_WORDS20}[p_size % 10] END AS word, CASE WHEN p_size < 20 THEN {_NTH20}[p_size] WHEN p_size % 10 = 0 THEN left({_TENS}[p_size // 10], length({_TENS}[p_size // 10]) - 1) || 'ieth' ELSE {_TENS}[p_size // 10] || '-' || {_NTH20}[p_size % 10] END AS nth FROM part) SELECT p_partkey, word, nth, CASE WHEN word LIKE '%x' THEN word || 'es' WHEN word LIKE '%y' THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END AS many, replace(word, '-', ' ') AS open_form FROM w")
def number_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings hold the cardinal, the ordinal and the plural, with a hyphen and without."""
    ship(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", formats.number_spellings("p_size").alias("all"), F.col("p_size").alias("n"))
    plain = F.filter("all", lambda w: ~w.contains(" "))
    is_nth = lambda w: w.rlike("(st|nd|rd|th)$")
    # Of the rest the plural is the one that the cardinal begins.
    rest = F.array_sort(F.filter(plain, lambda w: ~is_nth(w)))
    word = F.when(F.col("n") % 10 == 0, F.get(F.filter(rest, lambda w: ~w.endswith("s")), F.lit(0))).otherwise(F.get(rest, F.lit(0)))
    open_form = F.regexp_replace(word, "-", " ")
    held = F.when(F.array_contains("all", open_form), open_form)
    return rows.select("p_partkey", word.alias("word"), F.get(F.filter(plain, is_nth), F.lit(0)).alias("nth"), F.get(F.filter(rest, lambda w: w != word), F.lit(0)).alias("many"), held.alias("open_form"))


@query("SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE concat(CASE WHEN p_size >= 8 THEN (p_size // 8) || ' ' ELSE '' END, (p_size % 8) // gcd(p_size % 8, 8), '/', 8 // gcd(p_size % 8, 8)) END AS eighths, (p_partkey + 1) || '.5 million' AS millions, format('{:,}', p_partkey * 1000 + 1000) AS grouped FROM part")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, magnitude words and grouping, among all notations of a value."""
    ship(spark)
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    fraction = F.pandas_udf(lambda n: n.map(formats.fraction), "string")
    million = F.pandas_udf(lambda n: n.map(lambda x: formats.formatted(x, exponent=6, spell_magnitude=True, separator="")), "string")
    grouped = F.regexp_replace(F.format_number(F.col("p_partkey") * 1000 + 1000, 0), "", "")
    held = F.when(F.array_contains(formats.digit_notations(F.col("p_partkey") * 1000.0 + 1000), grouped), grouped)
    return part.select("p_partkey", fraction(F.col("p_size") / 8).alias("eighths"), million((F.col("p_partkey") + 1.5) * 1e6).alias("millions"), held.alias("grouped"))


@query("SELECT p_partkey, length('About ' || " + letters("p_partkey") + " || ' there are ')::INTEGER AS start, format('{:,}', p_partkey * 7 + 1200) AS shown FROM part")
def stated_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a sentence states a known value in one of its representations."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", n="CAST(p_partkey * 7 + 1200 AS DOUBLE)", t="concat('About ', " + letters("p_partkey") + ", ' there are ', format_number(p_partkey * 7 + 1200, 0), ' wheels, not ', p_partkey * 9 + 99, '.')")
    rows = dealt(rows, "p_partkey").select("p_partkey", "t", F.explode(phrases.stated_values("t", F.array("n"))).alias("s"))
    return rows.select("p_partkey", F.col("s.start").alias("start"), spans.substring(F.col("t"), F.col("s")).alias("shown"))


# --- Conversion templates --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, format('{:,}', p_partkey + 10) || ' kilometres (' || format('{:,}', CAST(round((p_partkey + 10) * 1000 / 1609.344) AS BIGINT)) || ' mi)' AS whole, format('{:,}', p_partkey + 10) || ' kg' AS lhs, format('{:,}', CAST(round((p_partkey + 10) * 1000 / 453.59237) AS BIGINT)) || ' lb' AS rhs FROM part")
def converted_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template calls with a given precision, one for each part, as long and as short forms."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", a="concat('{{convert|', p_partkey + 10, '|km|mi|0}}')", b="concat('{{cvt|', p_partkey + 10, '|kg|lb|0}}')")
    rows = rows.select("p_partkey", expanded_template("a").alias("a"), expanded_template("b").alias("b"))
    return rows.select("p_partkey", F.get("a", F.lit(2)).alias("whole"), F.get("b", F.lit(0)).alias("lhs"), F.get("b", F.lit(1)).alias("rhs"))


def _to(value: str, factor: str) -> str:
    return f"CAST(round(({value}) * {factor}) AS BIGINT)"


_MILES = "1000 / 1609.344"
_SMALL = ", ".join(f"'{w}'" for w in ("two", "three", "four", "five", "six", "seven", "eight", "nine"))
#: Forms of templates and what they show; n is a part's size and ten.
_FORMS = [
    ("{{convert|', n, '|–|', n + 5, '|km|mi|0}}", ["n", "'–'", "n + 5", "' kilometres ('", _to("n", _MILES), "'–'", _to("n + 5", _MILES), "' mi)'"]),
    ("{{convert|', n, '|to|', n + 5, '|km|mi|0}}", ["n", "' to '", "n + 5", "' kilometres ('", _to("n", _MILES), "' to '", _to("n + 5", _MILES), "' mi)'"]),
    ("{{convert|', n, '|km|mi|0|order=flip}}", [_to("n", _MILES), "' miles ('", "n", "' kilometres)'"]),
    ("{{convert|', n, '|km|mi|0|adj=on}}", ["n", "'-kilometre ('", _to("n", _MILES), "' mi)'"]),
    ("{{convert|', n, '|km|mi|0|abbr=on}}", ["n", "' km ('", _to("n", _MILES), "' mi)'"]),
    ("{{convert|', n, '|km|mi|0|sp=us}}", ["n", "' kilometers ('", _to("n", _MILES), "' mi)'"]),
    ("{{convert|', n, '|e6t|e6lb|0|abbr=off}}", ["n", "' million tonnes ('", _to("n", "1000 / 0.45359237"), "' million pounds)'"]),
    ("{{convert|', n, '|km|mi+nmi|0}}", ["n", "' kilometres ('", _to("n", _MILES), "' mi; '", _to("n", "1000 / 1852.0"), "' nmi)'"]),
    ("{{convert|', n, '+1//2|mi|km|0}}", ["n", "'+1/2 miles ('", _to("n + 0.5", "1.609344"), "' km)'"]),
    ("{{convert|', n, '|km|mi|0|adj=mid|-long}}", ["n", "'-kilometre-long ('", _to("n", _MILES), "' mi)'"]),
    ("{{cvt|', n, 'x', n + 1, 'x', n + 2, '|ft|cm|0|order=flip}}", [_to("n", "30.48"), "' cm × '", _to("n + 1", "30.48"), "' cm × '", _to("n + 2", "30.48"), "' cm ('", "n", "' ft × '", "n + 1", "' ft × '", "n + 2", "' ft)'"]),
    ("{{convert|', n, '|and|', n + 10, '|C|F|0}}", ["n", "' and '", "n + 10", "' °C ('", _to("n * 1.8 + 32", "1"), "' and '", _to("n * 1.8 + 50", "1"), "' °F)'"]),
    ("{{convert|', p_size % 8 + 2, '|ft|m|1|spell=in}}", [f"[{_SMALL}][p_size % 8 + 1]", "' feet ('", "round((p_size % 8 + 2) * 0.3048, 1)::DECIMAL(4, 1)", "' m)'"]),
    ("{{convert|', n, '|mi|km+mi|0|abbr=on|order=out}}", [_to("n", "1.609344"), "' km ('", "n", "' mi)'"]),
    ("{{convert|', n, '|PD/sqmi|PD/km2|0}}", ["n", "' inhabitants per square mile ('", _to("n", "1 / 2.589988110336"), "'/km2)'"]),
    ("{{convert|', n, '|in|mm|round=5}}", ["n", "' inches ('", "CAST(round(n * 25.4 / 5) * 5 AS BIGINT)", "' mm)'"]),
    ("{{convert|some ', n, '|km|mi}}", None),
]


@query(
    f"SELECT p_partkey, CASE p_partkey % {len(_FORMS)} "
    + " ".join(f"WHEN {k} THEN " + ("NULL" if parts is None else "concat(" + ", ".join("format('{:,}', " + e + ")" if "AS BIGINT" in e else e for e in parts) + ")") for k, (_, parts) in enumerate(_FORMS))
    + " END AS whole FROM (SELECT *, p_size + 10 AS n FROM part)"
)
def template_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of seventeen forms over all parts: ranges, flips, adjectives, prefixes, composites, fractions, sizes in
    three directions, temperatures, spelled numbers, steps of rounding, and one that can't be read."""
    ship(spark)
    call = f"CASE p_partkey % {len(_FORMS)} " + " ".join(f"WHEN {k} THEN concat('{t}')" for k, (t, _) in enumerate(_FORMS)) + " END"
    rows = table(spark, sf_dir, "part").withColumn("n", F.col("p_size") + 10).selectExpr("p_partkey", f"{call} AS t")
    return rows.select("p_partkey", F.get(expanded_template("t"), F.lit(2)).alias("whole"))


@query("SELECT p_partkey, concat('convert|', p_partkey, '|km|', p_name, '|x & y') AS clean FROM part")
def cleaned_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('{{convert|', p_partkey, '<ref name=\"a\">see | there</ref>|km<!-- no -->|[[Thing ', p_size, '|', p_name, ']]|x &amp; y}}')")
    return rows.select("p_partkey", text.cleaned_template("t").alias("clean"))


# --- Markup, sentences, normal forms ---------------------------------------------------------------------------------


@query("SELECT p_partkey, concat(p_name, ' is made of iron.') AS first, concat('## Size ', p_size) AS second, 'It is heavy.' AS third, 3 AS n FROM part")
def markup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without infoboxes, comments, references, links and emphasis, as paragraphs."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('{{Infobox part|size=', p_size, '|maker={{x|', p_brand, '}}}}''''''', p_name, ''''''' is [[metal|made of]] [[iron]].<ref>See ', p_brand, '</ref><!-- ', p_type, ' -->\\n\\n== Size ', p_size, ' ==\\n\\nIt is ( , ) heavy.')")
    rows = rows.select("p_partkey", text.paragraphs(text.cleaned_page("t")).alias("p"))
    part = lambda k: F.get("p", F.lit(k))
    return rows.select("p_partkey", part(0).alias("first"), part(1).alias("second"), part(2).alias("third"), F.size("p").alias("n"))


_S1, _S2, _S3 = "concat('The part of Dr. ', " + letters("p_partkey") + ", ' has e.g. ', p_size, '.5 wheels.')", "concat('Is it ', lower(p_type), '?')", "'It is.'"


@query(f"SELECT p_partkey, unnest([0, 1, 2, 3])::INTEGER AS sent_idx, unnest([{_S1}, {_S2}, chr(10) || chr(10), {_S3}]) AS sentence FROM part")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with abbreviations and decimals in them; a paragraph break is one of its own."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t=f"concat({_S1}, ' ', {_S2}, '\\n\\n', {_S3})")
    rows = rows.select("p_partkey", "t", F.posexplode(text.sentence_spans("t")).alias("sent_idx", "s"))
    return rows.select("p_partkey", "sent_idx", spans.substring(F.col("t"), F.col("s")).alias("sentence"))


def _decompositions() -> str:
    """A SQL map of all characters below U+3000 and of the presentation forms to what they are made of."""
    points = [c for c in map(chr, [*range(0x80, 0x3000), *range(0xFB00, 0xFB50), *range(0xFF01, 0xFF60)]) if unicodedata.normalize("NFKD", c) != c]
    return "MAP([" + ", ".join(f"'{c}'" for c in points) + "], [" + ", ".join("'" + unicodedata.normalize("NFKD", c).replace("'", "''") + "'" for c in points) + "])"


@query(f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text || ' ﬁnd ½ Å ǆ Ｗ²', '(?s).'), lambda c: coalesce(d.m[c], c)), '')) AS decomposed FROM documents, (SELECT {_decompositions()} AS m) AS d WHERE text IS NOT NULL")
def decomposed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility decomposition: accents become marks of their own, ligatures letters."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(text.nfkd(F.concat("text", F.lit(" ﬁnd ½ Å ǆ Ｗ²")))).alias("decomposed"))


@query("WITH d AS (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, chr(10) || chr(10)) ELSE p[1] || chr(10) || chr(10) || p[-1] END AS short FROM d")
def shortened_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last paragraph of each text, its sentences taken as paragraphs, too."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.shortened(F.regexp_replace("text", r"\. ", "\n\n")).alias("short"))


@query("SELECT conv_id, string_agg(text || ' 5 m ', '' ORDER BY turn) AS whole FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text with quantities between them; a quantity that could not be read adds nothing."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    runs = F.concat(F.transform("t", lambda x: x["text"]), F.array(F.lit("")))
    return turns.select("conv_id", text.full_text(runs, F.concat(F.transform("t", lambda x: F.lit(" 5 m ")), F.array(F.lit(None).cast("string")))).alias("whole"))


@query("SELECT p_partkey, concat('The ', p_name, ' is ', p_size, ' m long') AS clean, length(concat('The ', p_name, ' is '))::INTEGER AS start, length(concat('The ', p_name, ' is ', p_size, ' m'))::INTEGER AS \"end\" FROM part")
def postprocessed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftovers of markup go, spans move along."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat(', The [[', p_name, ']] is ', p_size, ' m ( , )long ')", a="CAST(length(concat(', The [[', p_name, ']] is ')) AS INT)", b="CAST(length(concat(', The [[', p_name, ']] is ', p_size, ' m')) AS INT)")
    rows = rows.select("p_partkey", text.postprocessed(F.col("t"), F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))).alias("x"))
    return rows.select("p_partkey", F.col("x.text").alias("clean"), F.get("x.spans", F.lit(0))["start"].alias("start"), F.get("x.spans", F.lit(0))["end"].alias("end"))


@query("SELECT p_partkey, length(p_name)::INTEGER + 1 AS outer_start, length(concat(p_name, ' (', p_brand, ' '))::INTEGER AS inner_start, 2 AS n FROM part")
def bracketed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat(p_name, ' (', p_brand, ' (', p_type, ')) x) (')")
    rows = rows.select("p_partkey", text.bracketed("t").alias("b"))
    return rows.select("p_partkey", F.get("b", F.lit(0))["start"].alias("outer_start"), F.get("b", F.lit(1))["start"].alias("inner_start"), F.size("b").alias("n"))


# --- Guards and filters ----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 2) AS is_share FROM lineitem")
def of_which_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "CASE l_linenumber WHEN 1 THEN concat('It has ', l_partkey, ' wheels, of which ') WHEN 2 THEN concat('It has ', l_partkey, ' of which, ') WHEN 3 THEN 'Of which ' WHEN 4 THEN concat(l_partkey, ' of which') ELSE 'It has ' END"
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", t=f"concat({head}, l_suppkey, ' are old.')", a=f"length({head})")
    return rows.select("l_orderkey", "l_linenumber", text.is_of_which(F.col("t"), F.col("a")).alias("is_share"))


_F1_TEXTS = ["concat('The tower of ', {n}, ' is ', {v}, ' tall and was built.')", "concat('File:', {n}, '.jpg | is ', {v}, ' tall there.')", "concat('It is ', {v}, ' so.')", "concat('The works of ', {n}, ' take ', {v}, ' per day of work.')", "concat('The debt of ', {n}, ' grew ', {v}, '% in the last year.')", "concat('The tower of ', {n}, ' is ', {v}, ' and 12 others stand.')", "concat('The tower of ', {n}, ' is ', {v}, ' and twelve others stand.')", "concat('On April 1, 1995 the tower of ', {n}, ' was ', {v}, ' tall, all in all.')"]
_V = "concat(p_partkey + 3, ' m')"


@query("SELECT p_partkey, [NULL, 'file_link', 'little_text', 'per', 'percent', 'other_number', 'other_number_word', NULL][p_partkey % 8 + 1] AS reason FROM part")
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantspark.functions import vocab

    ship(spark)
    texts = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {t.replace('{n}', letters('p_partkey')).replace('{v}', _V)}" for k, t in enumerate(_F1_TEXTS)) + " END"
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t=texts, a=f"locate({_V}, {texts}) - 1", b=f"locate({_V}, {texts}) - 1 + length({_V})")
    span = F.array(F.struct(F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end")))
    return rows.select("p_partkey", filters.sentence_drop_reason(F.col("t"), span, annotate.whitelisted("t"), list(vocab.blacklisted_terms())).alias("reason"))


@query("SELECT doc_id, term, contains(lower(text), term) AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}\\p{M}_])' || term) AS inside FROM documents, (VALUES ('one'), ('ten'), ('on'), ('e')) AS t(term) WHERE text IS NOT NULL")
def unanchored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text has a term inside other words only."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    inside = [F.struct(F.lit(w).alias("term"), (F.size(filters.unanchored_only(F.col("text"), [w])) > 0).alias("inside")) for w in ("one", "ten", "on", "e")]
    return docs.select("doc_id", F.inline(F.array(*inside)))


_DIGITS = "CAST(o_orderkey + 10 AS STRING)"


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AND length(CAST(o_orderkey AS VARCHAR)) > 4 AND length(rtrim(CAST(o_orderkey AS VARCHAR), '0')) > 1 OR o_orderkey % 2 = 1 AND length(CAST(o_orderkey AS VARCHAR)) > 2 AND o_orderkey % 3 > 0 AS rare FROM orders WHERE o_orderkey > 0")
def rare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts (even keys) with more than four digits that are no round power, other exact numbers with more than two and no percent sign."""
    rows = made(spark, sf_dir, "orders", o_orderkey="o_orderkey", t="CAST(o_orderkey AS STRING)", after="CASE WHEN o_orderkey % 3 = 0 THEN ' percent' ELSE ' km' END").where("o_orderkey > 0")
    return rows.select("o_orderkey", filters.is_rare(F.col("t"), F.lit(0.0), F.col("o_orderkey") % 2 == 0, F.col("after")).alias("rare"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'unit_adjecent_to_other_value' WHEN 2 THEN 'value_adjecent_to_other_unit' WHEN 3 THEN 'of_which_before_unit_annotation' END AS reason FROM lineitem")
def unit_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit far from its value beside another number, a value with another unit right after it, a share; else nothing."""
    v = "CAST(l_partkey + 10 AS STRING)"
    t = f"CASE l_linenumber WHEN 1 THEN concat({v}, ' and 44 m high') WHEN 2 THEN concat({v}, ' kg, in metres m') WHEN 3 THEN concat({v}, ' of which m') ELSE concat({v}, ' m high') END"
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", t=t, v=v, n="l_linenumber")
    size = F.length("v")
    at = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    unit_at = size + F.when(F.col("n") == 1, 8).when(F.col("n") == 2, 15).when(F.col("n") == 3, 10).otherwise(1)
    value, unit = at(F.lit(0), size), at(unit_at, unit_at + 1)
    others = F.when(F.col("n") == 1, F.array(value, at(size + 5, size + 7))).otherwise(F.array(value))
    frequent = F.when(F.col("n") == 2, F.array(at(size + 1, size + 3))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return rows.select("l_orderkey", "l_linenumber", filters.unit_drop_reason(F.col("t"), unit, value, others, frequent).alias("reason"))


@query("SELECT l_orderkey, l_linenumber, ['no_measured_entity', 'no_measured_property', NULL, 'multiple_properties', 'multiple_entities', 'of_which_before_property_annotation', 'of_which_before_entity_annotation'][l_linenumber] AS reason FROM lineitem")
def context_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    at = lambda a: F.struct(F.lit(a).cast("int").alias("start"), F.lit(a + 3).cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    entity = F.when(n == 1, none).when(n == 5, F.array(at(0), at(5))).when(n == 7, F.array(at(13))).otherwise(F.array(at(0)))
    prop = F.when(n.isin(2, 3), none).when(n == 4, F.array(at(0), at(5))).when(n == 6, F.array(at(13))).otherwise(F.array(at(0)))
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.lit("ABC, of which DEF"))
    # "of which " ends at 14.
    return rows.select("l_orderkey", "l_linenumber", filters.context_drop_reason(F.lit("ABC of which DEF"), entity, prop, n == 3).alias("reason"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber = 1 AND l_partkey % 3 = 0 OR l_linenumber IN (3, 4, 6) AND l_partkey % 3 < 2 OR l_linenumber = 2 AND l_partkey % 3 = 1 AS mixed FROM lineitem")
def mixed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A height beside ``wide``, a width beside ``high``, and so on; the words after the next comma don't count."""
    prop = "element_at(array('wdt:P2048', 'wdt:P2049', 'wdt:P4511', 'wdt:P2610', 'wdt:P9', 'wdt:P5524', 'wdt:P10'), l_linenumber)"
    t = "concat('A tower ', CASE l_partkey % 3 WHEN 0 THEN 'wide ' WHEN 1 THEN 'high ' ELSE '' END, l_suppkey, ' m, deep and thick')"
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", t=t, p=prop, a="8")
    value = F.struct(F.col("a").cast("int").alias("start"), (F.col("a") + 1).cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select("l_orderkey", "l_linenumber", filters.mixes_dimensions(F.col("t"), F.col("p"), value, none).alias("mixed"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'choose_single_annotation_based_on_parentheses' WHEN 2 THEN 'choose_single_annotation_based_on_subclause' END AS reason, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 1 END AS n FROM lineitem WHERE l_linenumber <> 5")
def reduced_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in parentheses after the first, one candidate in the value's clause, a tie that stays, a single span."""
    ship(spark)
    name = letters("l_partkey")
    t = f"CASE l_linenumber WHEN 1 THEN concat({name}, ' (', {name}, ' too) is 5 m high') WHEN 2 THEN concat('Its ', {name}, ' is 5 m, its ', {name}, ' is old') WHEN 3 THEN concat({name}, ' ', {name}) ELSE concat({name}, ' is 5 m') END"
    rows = made(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", t=t, m=f"CAST(length({name}) AS INT)").where("l_linenumber <> 5")
    n, m = F.col("l_linenumber"), F.col("m")
    at = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    first = F.when(n == 2, at(F.lit(4), m + 4)).otherwise(at(F.lit(0), m))
    second = F.when(n == 1, at(m + 2, 2 * m + 2)).when(n == 2, at(m + 17, 2 * m + 17)).otherwise(at(m + 1, 2 * m + 1))
    own = F.when(n <= 3, F.array(first, second)).otherwise(F.array(first))
    value = F.when(n == 2, at(m + 8, m + 9))
    out = rows.withColumn("r", filters.reduced(F.col("t"), own, F.array(value)))
    return out.select("l_orderkey", "l_linenumber", F.col("r.reason").alias("reason"), F.size("r.spans").alias("n"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS hit, CASE WHEN s_suppkey % 3 = 0 THEN length('It lies at ')::INTEGER END AS start FROM supplier")
def coordinate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates stated in full, with one side missing, or stated twice."""
    ship(spark)
    lat, lon = "concat(10 + s_nationkey, '.', 100 + s_suppkey % 900)", "concat(40 + s_nationkey, '.', 200 + s_suppkey % 700)"
    t = f"CASE s_suppkey % 3 WHEN 0 THEN concat('It lies at ', {lat}, '12 and ', {lon}, '7 degrees.') WHEN 1 THEN concat('It lies at ', {lat}, ' alone.') ELSE concat('At ', {lat}, ', ', {lon}, ' and ', {lon}, ' again.') END"
    rows = made(spark, sf_dir, "supplier", s_suppkey="s_suppkey", t=t, p=f"concat('Point(', {lon}, ' ', {lat}, ')')")
    start = F.get(matching.coordinate_spans("t", "p"), F.lit(0))["start"]
    return rows.select("s_suppkey", matching.coordinate_match(F.col("t"), F.col("p")).alias("hit"), start.alias("start"))


# --- Annotator -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'old red wheels per mile' WHEN 1 THEN 'wheels' END AS noun FROM part WHERE p_partkey % 3 < 2")
def counted_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noun that a number counts; none where it is a frequent unit or a verb comes first."""
    ship(spark)
    head = "concat('The town of ', " + letters("p_partkey") + ", ' has ')"
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", a=f"CAST(length({head}) AS INT)", v="CAST(p_partkey + 12 AS STRING)", t=f"concat({head}, p_partkey + 12, CASE p_partkey % 3 WHEN 0 THEN ' old red wheels per mile.' WHEN 1 THEN ' wheels, all in all.' ELSE ' metres of rope.' END)")
    find = F.pandas_udf(lambda t, a, v: t.combine(a + v.str.len(), lambda x, e: x[slice(*s)] if (s := annotate.count_noun(x, (0, int(e)), {"metre"})) else None), "string")
    return rows.select("p_partkey", find("t", "a", "v").alias("noun")).where("noun IS NOT NULL")


@query("SELECT p_partkey, concat('old stone bridge') AS grown, 'bridge' AS beside_unit, concat('Iron ', " + letters("p_partkey") + ", ' Tower') AS name FROM part")
def expanded_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property grows over its modifiers, but not over a frequent unit; an entity over the proper nouns beside it."""
    ship(spark)
    rows = dealt(made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('The old stone bridge of Iron ', " + letters("p_partkey") + ", ' Tower is long.')"), "p_partkey")
    wanted = {"grown": ("bridge", "property", set()), "beside_unit": ("bridge", "property", {"stone"}), "name": ("Iron", "entity", set())}

    def grow(t):
        import pandas as pd

        # One annotation serves all phrases of a text.
        toks = [annotate.tokens(x) for x in t]
        run = lambda word, tag, units: [x[slice(*annotate.expanded(x, (x.index(word), x.index(word) + len(word)), tag, [], k, units))] for x, k in zip(t, toks, strict=True)]
        return pd.DataFrame({name: run(*what) for name, what in wanted.items()})

    return rows.select("p_partkey", F.pandas_udf(grow, "grown string, beside_unit string, name string")("t").alias("s")).select("p_partkey", "s.*")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'It' WHEN 1 THEN 'the tower' END AS head_noun, CASE s_suppkey % 4 WHEN 0 THEN 'It' END AS pronoun, NULL AS none FROM supplier")
def coreferent_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for an entity that the sentence before is about, by each back-end; no mention where another is meant."""
    from quantspark.operators.coreference import stand_in

    ship(spark)
    name = "concat('Tower ', " + letters("s_suppkey") + ")"
    before = f"CASE s_suppkey % 4 WHEN 3 THEN concat('The debt, which ', {name}, ' dwarfs, is old.') ELSE concat({name}, ' is old.') END"
    rows = made(spark, sf_dir, "supplier", s_suppkey="s_suppkey", name=name, before=before, t="CASE s_suppkey % 4 WHEN 1 THEN 'In spring the tower is tall.' WHEN 2 THEN 'In spring the bridge is tall.' ELSE 'It is tall.' END")

    def found(back_end: str):
        def run(p, t, n):
            import pandas as pd

            return pd.Series([b[slice(*s)] if (s := stand_in(a, b, [c], back_end)) else None for a, b, c in zip(p, t, n, strict=True)])

        return F.pandas_udf(run, "string")("before", "t", "name")

    return rows.select("s_suppkey", *[found(b).alias(b) for b in ("head_noun", "pronoun")], F.when(found("none").isNotNull(), 1).cast("string").alias("none"))


@query("SELECT p_partkey, concat('Iron ', " + letters("p_partkey") + ", ' 7') AS name, 'April 1, 1995' AS date FROM part")
def whitelisted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and dates in which a number is no quantity."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('The old Iron ', " + letters("p_partkey") + ", ' 7 was built on April 1, 1995 by hand.')")
    rows = rows.select("p_partkey", "t", annotate.whitelisted("t").alias("s"))
    shown = F.transform("s", lambda s: spans.substring(F.col("t"), s))
    return rows.select("p_partkey", F.get(F.filter(shown, lambda x: x.startswith("Iron")), F.lit(0)).alias("name"), F.get(F.filter(shown, lambda x: x.endswith("1995")), F.lit(0)).alias("date"))


@query("SELECT p_partkey, 6 AS n_tokens, 'be' AS verb, 1 AS n_numbers, 'tall' AS modifier FROM part")
def annotated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the annotations that are asked for: tokens with lemmas and heads, and numbers."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="concat('Wheels were ', p_partkey + 1, ' metres tall.')")
    rows = annotate.components(rows, "t", ("tokens", "numbers"))
    verb = F.filter("tokens", lambda t: t["pos"] == "AUX")
    adjective = F.filter("tokens", lambda t: t["pos"] == "ADJ")
    return rows.select("p_partkey", F.size("tokens").alias("n_tokens"), F.get(verb, F.lit(0))["lemma"].alias("verb"), F.size("numbers").alias("n_numbers"), F.get(adjective, F.lit(0))["text"].alias("modifier"))
