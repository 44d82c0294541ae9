"""Phrase joins and frequencies of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.numbers import parse_plain
from quantspark.operators.annotate import annotated, lemmas
from quantspark.operators.phrases import text_hits, word_hits
from quantspark.operators.ranks import between, numbered


def phrase_hits(texts: DataFrame, keys: list[str], phrases: DataFrame, text: str = "text") -> DataFrame:
    """(keys, hit, phrase) for each occurrence of a phrase (table id, phrase) in a text, by lemmas."""
    phrases = phrases.select(F.col("id").alias("hit"), F.array_join(lemmas(F.col("phrase")), " ").alias("phrase")).where("phrase <> ''").distinct()
    return text_hits(texts, keys, text, phrases).select(*keys, "phrase").join(phrases, "phrase")


def _form(token: Column, form: str) -> Column:
    return F.lower(token["text"]) if form == "lower" else token[form]


def alias_phrases(aliases: DataFrame, form: str = "lemma", column: str = "alias") -> DataFrame:
    """Aliases with the ``form`` of their tokens as ``phrase``; aliases without a word are left out.

    Each distinct alias is annotated once, by the annotator that also makes the tokens of sentences.
    """
    named = aliases.select(column).distinct().withColumn("__t", annotated(column)).where(F.size("__t") > 0)
    return aliases.join(named.select(column, F.array_join(F.transform("__t", lambda t: _form(t, form)), " ").alias("phrase")), column)


def longest_first(spans: Column) -> Column:
    """Of spans that overlap only the longest (then the first), in order."""
    by_size = F.array_sort(spans, lambda a, b: F.coalesce(F.nullif((b["end"] - b["start"]) - (a["end"] - a["start"]), F.lit(0)), a["start"] - b["start"]))
    pick = lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s)))
    return F.array_sort(F.aggregate(by_size, F.array().cast("array<struct<start:int,end:int>>"), pick))


def alias_spans(sentences: DataFrame, keys: list[str], aliases: DataFrame, form: str = "lemma") -> DataFrame:
    """(keys, kind, uri, spans): where sentences (keys, tokens) name a resource of ``aliases`` (kind, uri, alias).

    Aliases are compared by their tokens' ``form``: lemma, or lower for the text in lower case. Where aliases of one
    resource overlap the longest stays.
    """
    phrases = alias_phrases(aliases.select("kind", "uri", "alias").distinct(), form)
    rows = sentences.select(*keys, "tokens", F.transform("tokens", lambda t: _form(t, form)).alias("__w"))
    hits = word_hits(rows, [*keys, "tokens"], "__w", phrases)
    span = F.struct(F.get("tokens", F.col("first"))["start"].cast("int").alias("start"), F.get("tokens", F.col("last"))["end"].cast("int").alias("end"))
    named = hits.select(*keys, "phrase", span.alias("span")).join(phrases.select("kind", "uri", "phrase").distinct(), "phrase")
    found = named.groupBy(*keys, "kind", "uri").agg(F.collect_set("span").alias("spans"))
    return found.select(*keys, "kind", "uri", longest_first(F.col("spans")).alias("spans"))


def unit_frequencies(texts: DataFrame, keys: list[str], units: DataFrame, labels: DataFrame, stop: DataFrame) -> DataFrame:
    """(qid, n) of all labelled ``units`` (qid): occurrences of their aliases, zero where there is none."""
    aliases = units.join(labels.where("kind = 'units'"), F.col("qid") == F.col("uri")).select(F.col("qid").alias("id"), F.col("alias").alias("phrase"))
    aliases = aliases.join(stop, F.lower("phrase") == F.col("word"), "left_anti")
    counted = phrase_hits(texts, keys, aliases).groupBy("hit").agg(F.count(F.lit(1)).alias("hits"))
    labelled = aliases.select(F.col("id").alias("qid")).distinct()
    return labelled.join(counted, labelled["qid"] == counted["hit"], "left").select("qid", F.coalesce("hits", F.lit(0)).alias("n"))


def unlabelled(units: DataFrame, labels: DataFrame) -> DataFrame:
    return units.join(labels.where("kind = 'units'"), F.col("qid") == F.col("uri"), "left_anti")


def ranked(frequencies: DataFrame) -> DataFrame:
    """By count, then by identifier."""
    return numbered(frequencies, F.desc("n"), "qid")


def top(frequencies: DataFrame, percent: int = 50, mode: str = "top_x_of_not_zero") -> DataFrame:
    """Frequent units: ``not_zero``, the top ``percent`` of those (``top_x_of_not_zero``) or of all (``top_x``)."""
    some = frequencies if mode == "top_x" else frequencies.where("n > 0")
    if mode == "not_zero":
        return some
    most = some.agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("most"))
    return ranked(some).join(F.broadcast(most), F.col("rank") <= F.col("most")).drop("most", "rank")


def frequent_aliases(frequent: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct aliases of frequent units that aren't numbers themselves, in order."""
    aliases = frequent.join(labels.where("kind = 'units'"), F.col("qid") == F.col("uri")).select("alias").distinct()
    return aliases.where(parse_plain(F.col("alias")).isNull()).orderBy("alias")


def ends(frequencies: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The ``n`` most and least frequent units."""
    return frequencies.orderBy(F.desc("n"), "qid").limit(n), frequencies.orderBy("n", "qid").limit(n)


def excluded(conversions: DataFrame, frequencies: DataFrame, without_labels: DataFrame | None = None, infrequent: bool = False, unit: str = "to_unit") -> DataFrame:
    """Conversions to units that have a label and, if asked, are found at all; or such units, where ``unit`` names their column."""
    out = conversions
    if without_labels is not None:
        out = out.join(without_labels.select(F.col("qid").alias(unit)), unit, "left_anti")
    if infrequent:
        out = out.join(frequencies.where("n = 0").select(F.col("qid").alias(unit)), unit, "left_anti")
    return out.select(*conversions.columns)


def pages_to_analyse(pages: DataFrame, limit: int | None = None, quantities_only: bool = False) -> DataFrame:
    """All pages, or the first ``limit`` by id; with ``quantities_only`` only pages that have quantities count."""
    some = pages.where(F.size("quantities") > 0) if quantities_only else pages
    return between(some, "id", limit=limit)


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.size("quantities") > 0).alias("n_with_quantities"))
