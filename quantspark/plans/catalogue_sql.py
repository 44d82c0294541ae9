"""Queries in SQL with the engine's table functions, and vocabularies against the words of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions import tables as functions
from quantspark.functions import vocab
from quantspark.operators import annotate
from quantspark.plans.registry import made, query, table
from quantspark.session import ship


def _sql(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    functions.register(spark)
    return spark.sql(text, **{name: table(spark, sf_dir, name)})


@query("SELECT doc_id, unnest([0, 1, 2]) AS sent_idx, unnest(['It comes from ' || source || '.', 'It has e.g. ' || n_chars || ' signs.', 'That is all.']) AS sentence FROM documents WHERE source IS NOT NULL")
def lateral_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "documents", "SELECT doc_id, s.sent_idx, s.sentence FROM {documents}, LATERAL split_sentences('It comes from ' || source || '. It has e.g. ' || n_chars || ' signs. That is all.') AS s WHERE source IS NOT NULL")


@query("SELECT doc_id, (n_chars + 100000)::VARCHAR AS number, (n_chars + 100000)::DOUBLE AS value, length('The text has ') AS start FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT doc_id, 'twenty-five', 25, length('The text has ' || (n_chars + 100000) || ' signs and ') FROM documents WHERE n_chars IS NOT NULL")
def lateral_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "documents", "SELECT doc_id, n.number, n.value, CAST(n.start AS BIGINT) AS start FROM {documents}, LATERAL find_numbers('The text has ' || (n_chars + 100000) || ' signs and twenty-five parts.') AS n WHERE n_chars IS NOT NULL")


_CARDINALS = "['two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve']"
_ORDINALS = "['second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth', 'eleventh', 'twelfth']"


@query(f"WITH d AS (SELECT doc_id, {_CARDINALS}[doc_id % 11 + 1] AS c, {_ORDINALS}[doc_id % 11 + 1] AS o FROM documents) SELECT doc_id, unnest([c, o, CASE right(c, 1) WHEN 'x' THEN c || 'es' ELSE c || 's' END]) AS spelling FROM d")
def lateral_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "documents", "SELECT doc_id, s.spelling FROM {documents}, LATERAL number_spellings(CAST(doc_id % 11 + 2 AS DOUBLE)) AS s")


@query("SELECT doc_id, unnest([format('{:,}', doc_id + 1000000), (doc_id + 1000000)::VARCHAR, replace(format('{:,}', doc_id + 1000000), ',', ' ')]) AS notation FROM documents")
def lateral_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notations of a whole number that have all of its digits and no other sign."""
    return _sql(spark, sf_dir, "documents", "SELECT doc_id, n.notation FROM {documents}, LATERAL digit_notations(CAST(doc_id + 1000000 AS DOUBLE)) AS n WHERE n.notation RLIKE '^[0-9 ,]+$' AND regexp_replace(n.notation, '[ ,]', '') = CAST(doc_id + 1000000 AS STRING)")


#: Words that stand for numbers, of all vocabularies, and some that don't (fixed values).
_NUMBER_WORDS = "('one', 1), ('two', 2), ('three', 3), ('five', 5), ('ten', 10), ('twelve', 12), ('twenty', 20), ('ninety', 90), ('hundred', 100), ('thousand', 1000), ('million', 1000000), ('billion', 1000000000), ('first', 1), ('second', 2), ('third', 3), ('tenth', 10), ('twelfth', 12), ('thousandth', 1000)"


@query(f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents UNION ALL SELECT doc_id, unnest(list_transform(['one', 'twelfth', 'million', 'tables', 'ninety', 'second', 'thousandth'], lambda x, i: CASE WHEN (doc_id + i) % 3 = 0 THEN x ELSE '' END)) FROM documents), v AS (SELECT * FROM (VALUES {_NUMBER_WORDS}) AS v(word, value)) SELECT doc_id, w.word, count(*) AS n, any_value(v.value)::DOUBLE AS value FROM w JOIN v ON w.word = v.word GROUP BY doc_id, w.word")
def number_words_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words (and planted ones) that some vocabulary gives a value, with that value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("own"))
    planted = F.array(*[F.when((F.col("doc_id") + i) % 3 == 0, w).otherwise("") for i, w in enumerate(("one", "twelfth", "million", "tables", "ninety", "second", "thousandth"), 1)])
    words = docs.select("doc_id", F.explode(F.concat(F.coalesce("own", F.array().cast("array<string>")), planted)).alias("word"))
    known = vocab.vocabulary(spark).where("kind IN ('cardinal', 'ordinal', 'magnitude')").select(F.col("term").alias("word"), "value").distinct()
    asked = spark.sql(f"SELECT word FROM VALUES {_NUMBER_WORDS} AS t(word, expected)")
    return words.join(F.broadcast(known.join(asked, "word")), "word").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))


@query("SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['5 / 8'] WHEN 1 THEN ['- ' || (p_size + 20)] ELSE ['one third', (p_size + 20)::VARCHAR] END) AS number FROM part")
def tagged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by tags, with signs and ordinals beside them."""
    ship(spark)
    rows = made(spark, sf_dir, "part", p_partkey="p_partkey", t="CASE p_partkey % 3 WHEN 0 THEN 'About 5 / 8 of it is left.' WHEN 1 THEN concat('It has - ', p_size + 20, ' degrees.') ELSE concat('Some one third of ', p_size + 20, ' wheels are old.') END")
    found = rows.select("p_partkey", "t", F.explode(annotate.tagged_number_spans("t")).alias("s"))
    return found.select("p_partkey", F.substring("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("number"))
