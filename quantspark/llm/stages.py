"""The stages of the corpus pipeline as functions (spark, docs, sf_dir).

Each takes documents (doc_id, text, lang, source and any others) and keeps their columns, whatever their names. Nulls in
any column, blank and very long texts, repeated rows, ties and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantspark.llm import exact_dedup, mixing, near_dedup, packing, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, blank and short texts don't."""
    return quality.keep_good(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id, nulls last."""
    return exact_dedup.keep_first(docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest doc_id, nulls last."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the null source is one of its own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a result of its own, which reads nothing of ``docs`` any more."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", distinct_texts),
    ("minhash_near_dedup", distinct_classes),
    ("mixing", mixed),
    ("packing", packed),
]
