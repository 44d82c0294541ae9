"""Quantity dataset: sentences whose quantities are exactly delimited by conversion templates."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions import vocab
from quantspark.functions.numbers import SPAN
from quantspark.functions.text import postprocessed, sentence_spans
from quantspark.operators.annotate import whitelisted
from quantspark.operators.filters import sentence_drop_reason
from quantspark.session import ship

RENDERINGS = ((475, 1), (950, 2), (1000, 3))


def rendered(quantities: F.Column, seed: F.Column) -> F.Column:
    """One rendering of each quantity: left, right or both sides in 47.5, 47.5 and 5 of 100 cases, by a hash of its place."""

    def pick(q: F.Column, i: F.Column) -> F.Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % 1000
        side = F.when(h < 475, F.get(q, F.lit(0))).when(h < 950, F.get(q, F.lit(1))).otherwise(F.get(q, F.lit(2)))
        return F.coalesce(side, F.get(q, F.lit(2)), F.lit(""))

    return F.transform(quantities, pick)


def laid_out(pages: DataFrame) -> DataFrame:
    """Pages (id, title, text runs, quantities) as full texts with the spans of their quantities."""
    runs = F.transform("text", lambda p: F.array_join(p, "\n\n"))
    chosen = pages.select("id", "title", runs.alias("runs"), rendered(F.coalesce("quantities", F.array().cast("array<array<string>>")), F.col("id")).alias("q"))
    pieces = F.flatten(F.transform(F.arrays_zip("runs", "q"), lambda z: F.array(F.coalesce(z["runs"], F.lit("")), F.coalesce(z["q"], F.lit("")))))
    rows = chosen.select("id", "title", F.explode(F.array(joined(pieces))).alias("j"))
    return rows.select("id", "title", "j.text", "j.quantities")


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("quantities", SPAN)]))
def joined(pieces: pa.Array) -> pa.Array:
    """Pieces, of which every second is a quantity, as one text in its compatibility decomposition, with their spans.

    Forms come first, as spans count characters of the normalised text.
    """
    out = []
    for row in pieces.to_pylist():
        text, spans, at = [unicodedata.normalize("NFKD", p) for p in row or ()], [], 0
        for k, piece in enumerate(text):
            if k % 2 and piece:
                spans.append({"start": at, "end": at + len(piece)})
            at += len(piece)
        out.append({"text": "".join(text), "quantities": spans})
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.array(out, pa.struct([("text", pa.string()), ("quantities", pa.list_(span))]))


def sentences_of(texts: DataFrame) -> DataFrame:
    """(id, title, sent_idx, start, sentence, spans): sentences with the quantity spans that lie fully inside them."""
    split = texts.withColumn("sentences", sentence_spans("text"))
    rows = split.select("id", "title", "text", "quantities", F.posexplode("sentences").alias("sent_idx", "s"))
    inner = F.filter("quantities", lambda q: (q["start"] >= F.col("s.start")) & (q["end"] <= F.col("s.end")))
    moved = F.transform(inner, lambda q: F.struct((q["start"] - F.col("s.start")).cast("int").alias("start"), (q["end"] - F.col("s.start")).cast("int").alias("end")))
    return rows.select("id", "title", "sent_idx", F.col("s.start").alias("start"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence"), moved.alias("spans"))


def examples(pages: DataFrame) -> DataFrame:
    """(id, title, sent_idx, sentence, quantities, drop_reason) of all sentences with quantities; accepted ones are cleaned.

    Only pages with quantities are read on; all is row-wise, so nothing is shuffled.
    """
    ship(pages.sparkSession)
    some = pages.where(F.size("quantities") > 0)
    found = sentences_of(laid_out(some)).where(F.size("spans") > 0)
    words = F.size(F.split(F.trim("sentence"), r"\s+"))
    found = found.where((words >= 3) & ~F.col("sentence").startswith("##") & (F.col("sentence") != "\n\n"))
    judged = found.withColumn("drop_reason", sentence_drop_reason(F.col("sentence"), F.col("spans"), whitelisted("sentence"), list(vocab.blacklisted_terms())))
    clean = judged.withColumn("clean", postprocessed("sentence", "spans"))
    return clean.select("id", "title", "sent_idx", F.col("clean.text").alias("sentence"), F.col("clean.spans").alias("quantities"), "drop_reason")


def dataset(pages: DataFrame) -> DataFrame:
    """The quantity dataset: flat rows of accepted sentences."""
    return examples(pages).where("drop_reason IS NULL").drop("drop_reason")
