"""Quality rules: base counts of words and lines, and tokeniser fertility with rejection bands for each language.

A public vocabulary with byte fallback is applied to the words of a text (each as it stands after a space).
Three measures come from it: characters per token, the share of tokens that are single fallback bytes, and the
entropy of the text's token distribution against the most that its length allows. Text in the vocabulary's
languages has all three in a narrow range; shouting, symbol noise and wrong encodings leave it.

Bands are learned from the corpus itself: medians and median deviations over *all* documents of a language that
pass the base rules. A band narrows with the root of a text's length, as the measures do, and has at least a fixed
width. Few clean documents fall outside; short noisy ones can stay inside (figures in the README).
Two narrow aggregates and one broadcast of a row for each language (languages beyond ``MAX_BROADCAST_LANGUAGES``
are joined by a shuffle) are all that leaves the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.store import cut
from quantspark.llm.words import WordIds, Words, chunks, gather, mix, prefix, ranges, span_hashes
from quantspark.session import ship

#: Tokens over which entropy is taken, so that it doesn't depend on a text's length; a shorter rest joins the last window.
ENTROPY_WINDOW = 64
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_BROADCAST_LANGUAGES = 10_000
#: The half-width of each measure's band in its scales, and the least half-width. Those of characters per token and
#: entropy are set from labelled documents (README); none of these holds a fallback byte, so that of bytes is by choice.
SPREADS = {"chars_per_token": 10.5, "byte_share": 8.0, "token_entropy": 6.0}
FLOORS = {"chars_per_token": 0.1, "byte_share": 0.05, "token_entropy": 0.02}
MEASURES = tuple(FLOORS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True
_LETTER_START = (np.arange(256) & 0xC0) != 0x80

METRIC_FIELDS = [
    pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
] + [pa.field(n, pa.float64()) for n in MEASURES]
METRICS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_MODELS: dict[str, tuple[WordIds, np.ndarray]] = {}


def _model(path: str) -> tuple[WordIds, np.ndarray]:
    """The vocabulary at ``path``, and for each id whether it is a fallback byte; loaded once for each worker."""
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        _MODELS[path] = WordIds(lambda words: model.encode(words, num_threads=1)), is_byte
    return _MODELS[path]


def _repeat_words(words: Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """For each row, its words that lie in a window of ``size`` words found twice or more in the row."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    start = np.flatnonzero(np.arange(n) + size <= words.first[1:][words.doc]) if n else np.empty(0, np.int64)
    if len(start):
        sums, back = prefix(hashes)
        keys = ranges(sums, back, start, start + size) ^ mix(words.doc[start].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(size):
            covered[start[twice] + k] = True
    return np.bincount(words.doc[covered], minlength=words.n_docs)


def _dup_lines(words: Words) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier line."""
    if not len(words.raw):
        return np.zeros(words.n_docs, np.int64)
    breaks = np.flatnonzero(words.raw == 10)
    start = np.concatenate([words.at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(words.n_docs), np.searchsorted(words.at, breaks, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = words.at[1:][doc].copy()
    follows = doc[1:] == doc[:-1]
    end[:-1][follows] = start[1:][follows] - 1
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    keys = span_hashes(words.raw, start, end) ^ mix(doc.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    repeated = np.ones(len(keys), bool)
    repeated[first] = False
    return np.bincount(doc[repeated], minlength=words.n_docs)


def measure(column: pa.Array, vocabulary: str) -> list[np.ndarray]:
    """The columns of METRICS_DDL for a chunk of texts."""
    words = Words(column)
    hashes = words.hashes()
    word_chars = words.per_doc(_LETTER_START[words.raw] & words.inside)
    n_symbols = words.per_doc(_SYMBOL[words.raw])

    model, is_byte = _model(vocabulary)
    begin, each = model.of(words, hashes)
    token = gather(model.flat, begin, each)
    doc = np.repeat(words.doc, each)
    n_tokens = np.bincount(doc, minlength=words.n_docs)
    n_bytes = np.bincount(doc[is_byte[token]], minlength=words.n_docs)
    entropy = np.zeros(words.n_docs)
    if len(token):
        ahead = np.cumsum(n_tokens) - n_tokens
        n_windows = np.maximum(1, n_tokens // ENTROPY_WINDOW)
        first_window = np.cumsum(n_windows) - n_windows
        window = first_window[doc] + np.minimum((np.arange(len(token)) - ahead[doc]) // ENTROPY_WINDOW, n_windows[doc] - 1)
        key = window << 32 | token
        key.sort()
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(edge, len(key)))
        window = key[edge] >> 32
        size_of = np.bincount(window, n, int(n_windows.sum()))
        share = n / size_of[window]
        bits = np.bincount(window, -share * np.log2(share), len(size_of)) / np.log2(np.maximum(2, size_of))
        entropy = np.bincount(np.repeat(np.arange(words.n_docs), n_windows), bits, words.n_docs) / n_windows
    some = np.maximum(1, n_tokens)
    return [words.count, word_chars, n_symbols, _dup_lines(words), _repeat_words(words, hashes), n_tokens, word_chars / some, n_bytes / some, np.round(entropy, 12)]


def metrics(docs: DataFrame, columns: list[str], vocabulary: str | None = None) -> DataFrame:
    """``columns`` of each document and the columns of METRICS_DDL; ``columns`` may not clash with those."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = docs.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                found = measure(part.column(part.num_columns - 1), path)
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                fields = [part.schema.field(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(v, f.type) for v, f in zip(found, METRIC_FIELDS, strict=True)], schema=pa.schema(fields + METRIC_FIELDS))

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [METRICS_DDL])
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, ddl)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """For each language the centre of each measure and its scale, over all documents that pass the base rules.

    The centre is the median; the scale is the median of ``|x - centre| * sqrt(n_words)``, because each measure is
    a mean over a text and so varies with one over the root of its length.
    """
    accuracy = F.lit(10_000)
    good = measured.where(~base_failed()).withColumn("band", F.coalesce("lang", F.lit("")))
    centres = good.groupBy("band").agg(*[F.percentile_approx(m, F.lit(0.5), accuracy).alias(f"{m}_centre") for m in MEASURES])
    away = _with_bands(good, cut(centres))
    scales = away.groupBy("band").agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_centre")) * F.sqrt("n_words"), F.lit(0.5), accuracy).alias(f"{m}_scale") for m in MEASURES])
    return centres.join(scales, "band")


def _with_bands(measured: DataFrame, limits: DataFrame) -> DataFrame:
    if limits.count() <= MAX_BROADCAST_LANGUAGES:
        limits = F.broadcast(limits)
    return measured.join(limits, "band", "left")


def judge(measured: DataFrame, limits: DataFrame, spreads: dict[str, float] = SPREADS) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: inside its language's band in every measure.

    A language without a band (no document of it passes the base rules) rejects nothing beyond the base rules.
    """
    joined = _with_bands(measured.withColumn("band", F.coalesce("lang", F.lit(""))), limits)
    inside = F.lit(True)
    for m, floor in FLOORS.items():
        width = F.greatest(F.lit(floor), spreads[m] * F.col(f"{m}_scale") / F.sqrt(F.greatest(F.lit(1), "n_words")))
        inside = inside & F.coalesce(F.abs(F.col(m) - F.col(f"{m}_centre")) <= width, F.lit(True))
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("band", *[f"{m}_{x}" for m in MEASURES for x in ("centre", "scale")])


def quality_rules(docs: DataFrame, vocabulary: str | None = None, spreads: dict[str, float] = SPREADS) -> DataFrame:
    """Base counts, fertility measures and verdict of each document (doc_id, text, lang; other columns are ignored).

    Null or blank texts have zero counts and fail the base rules; a null language is a band of its own; rows
    repeated or sharing a doc_id are judged one by one; an empty table gives an empty result.
    """
    measured = cut(metrics(docs, ["doc_id", "lang"], vocabulary))
    return judge(measured, cut(bands(measured)), spreads)


def keep_good(docs: DataFrame, vocabulary: str | None = None, spreads: dict[str, float] = SPREADS) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Measured in two scans: one for the bands, one that filters; no text is shuffled and no row is keyed by doc_id.
    """
    path = vocabulary or default_vocabulary()
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "lang", "text")
    limits = cut(bands(cut(metrics(docs, ["lang"], path))))
    return judge(metrics(packed, ["__row", "lang"], path), limits, spreads).where("kept").select("__row.*")
