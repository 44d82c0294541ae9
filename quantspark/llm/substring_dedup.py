"""Substring deduplication by greedy relative Lempel-Ziv parsing over an index of reference blocks.

The whole corpus is the reference. Its index holds anchors: in every window of ``WINDOW`` words the smallest hashed
run of ``ANCHOR`` words (leftmost on ties). Equal windows have equal anchors in equal places, so every repeated window
is found under its anchor. Windows of a text that share an anchor are one candidate, about nine windows long.

1. Seeds: a candidate whose anchor and words are those of an earlier one is a seed, with the place of the first one as
   its source. Where an anchor's entry holds different candidates (a repeat begins or ends there), the first text of
   each is looked up window by window, and again the first start of a window is the source of the later ones.
2. Reference blocks: seeds that lie on from one another in one source are one range. The blocks of ``BLOCK_WORDS`` words
   that ranges and their surroundings lie in are cut out of their sources, each once, and brought to the texts that
   refer to them, however long a source is and however many texts refer to it.
3. Parse: a text's words are compared with its sources' words, and each match is extended to the left and right as far
   as words agree, but no further than ``MARGIN`` words beyond its seeds: what follows has an even earlier source, and
   seeds of its own. From left to right the longest match from the place at hand on is the next factor; factors of
   ``WINDOW`` words or more are duplicates. At a factor's end all windows across the border are checked as well, since
   another source may hold them.

"Earlier" is the smaller doc_id, then the smaller start. Candidates that an Arrow batch already holds an earlier copy
of are settled there, and a text that repeats itself or a batch of copies sends one entry of each kind; only what is
left, about one narrow row for every seven words, is shuffled, once, by anchor. An anchor that is frequent in ever new
surroundings would gather one row for each in one task: rows are counted in ``ROUTES`` buckets of anchors, and those of a
bucket of more than ``HOT`` times the mean are dealt out by anchor and words. Which anchors are there together is then not
known, so all their first texts are looked up window by window, which finds the same repeats.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.store import discard, fresh_path, stored, table
from quantspark.llm.words import BASE, BASE2, Words, chunks, mix, prefix, ranges
from quantspark.session import ship

WINDOW = 20
ANCHOR = 8

#: Words of a reference block, and how far a match is extended beyond its seeds on either side: were it longer by a whole
#: window, that window would be a seed of its own.
BLOCK_WORDS, MARGIN = 64, WINDOW - 1

#: Buckets of anchors whose rows are counted, and how many times the mean makes one hot. At most ROUTES / HOT can be.
ROUTES, HOT = 65_536, 8

#: ``span``: the first window's start times WINDOW, plus the number of further windows. ``words`` is null where the
#: batch holds an earlier copy, which then is the source; the anchor is an arbitrary number, as no entry is needed.
_SOURCE = ("src_doc", "src_row", "src_lo")
_FACTOR = pa.schema([(n, pa.int64()) for n in ("anchor", "words", "doc_id", "row_id", "span", *_SOURCE)])
_SOURCE_DDL = "src_doc long, src_row long, src_lo long"
_FACTOR_DDL = f"anchor long, words long, doc_id long, row_id long, span long, {_SOURCE_DDL}"
_SPAN_DDL = f"key long, key2 long, doc_id long, row_id long, lo long, {_SOURCE_DDL}"
_RANGE = pa.struct([(n, pa.int64()) for n in ("lo", "hi", *_SOURCE)])
_RANGES_DDL = "doc_id long, row_id long, ranges array<struct<lo:long,hi:long,src_doc:long,src_row:long,src_lo:long>>"
_KEPT_DDL = "n_words long, n_removed long, kept_sha256 string"


def _order(doc_id: pa.Array) -> np.ndarray:
    """doc_ids as numbers in their order, nulls first."""
    values = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = doc_id.is_null().to_numpy(zero_copy_only=False)
    _, rank = np.unique(values, return_inverse=True)
    return np.where(null, -1, rank)


def _first_of(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is the first of those with its keys, in ``order``, or ties with the first; and which that is."""
    by = np.lexsort(order[::-1] + keys[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.ones(len(by), bool)
    for o in order:
        first[by] &= o[by] == o[by][start]
    which = np.empty(len(by), np.int64)
    which[by] = by[start]
    return first, which


def _sources(first: np.ndarray, which: np.ndarray, doc_id: pa.Array, row_id: pa.Array, lo: np.ndarray) -> list[pa.Array]:
    """The columns of _SOURCE for rows that aren't the first of their kind in a batch."""
    at = pa.array(which, mask=first)
    return [doc_id.take(at), row_id.take(at), pa.array(lo).take(at)]


def _scattered(row_id: pa.Array, lo: np.ndarray) -> np.ndarray:
    """Keys for what is settled already, so that it doesn't gather at a frequent key."""
    return mix(row_id.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ mix(lo.astype(np.uint64)))


def _candidates(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each candidate factor: anchor hash, words' hash, row, first and last window start (within the row)."""
    hashes = words.hashes()
    n = len(hashes)
    starts = np.flatnonzero(np.arange(n) + window <= words.first[1:][words.doc]) if n else np.empty(0, np.int64)
    if not len(starts):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    sums, back = prefix(hashes)
    runs = ranges(sums, back, np.arange(n - anchor + 1), np.arange(anchor, n + 1))
    place = starts + np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1)[starts].argmin(1)
    new = np.append(True, (place[1:] != place[:-1]) | (words.doc[starts[1:]] != words.doc[starts[:-1]]))
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    row = words.doc[lo]
    # The anchor's place within the factor belongs to the factor's identity.
    content = ranges(sums, back, lo, hi + window) ^ mix((place[new] - lo).astype(np.uint64))
    return runs[place[new]], content, row, lo - words.first[row], hi - words.first[row]


def _factors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            order = _order(batch.column(0))
            at = 0
            for part in chunks(batch):
                key, content, row, lo, hi = _candidates(Words(part.column(2)), window, anchor)
                found.append((key, content, row + at, lo, hi))
                at += part.num_rows
            if not found:
                continue
            key, content, row, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
            first, which = _first_of((key, content), (order[row], lo))
            doc_id, row_id = batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))
            key = np.where(first, key, _scattered(row_id, lo))
            columns = [pa.array(key.view(np.int64)), pa.array(content.view(np.int64), mask=~first), doc_id, row_id, pa.array(lo * window + hi - lo), *_sources(first, which, doc_id, row_id, lo)]
            yield pa.RecordBatch.from_arrays(columns, schema=_FACTOR)

    return run


def _inside(words: Words, spans: pa.Array) -> np.ndarray:
    """A mark on each word position that starts a window of ``spans`` (a list of lo, hi for each row)."""
    marks = np.zeros(len(words.doc) + 1, np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    np.add.at(marks, words.first[row] + lo, 1)
    np.add.at(marks, words.first[row] + hi + 1, -1)
    return np.cumsum(marks)[:-1] > 0


def _spans(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32), column.flatten())


def _windows(window: int):
    """Two hashes of every window inside the spans of a row, and its start; the second is null for repeats for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(2))
                hashes = words.hashes()
                start = np.flatnonzero(_inside(words, _spans(part.column(3))))
                keys = [ranges(*prefix(hashes, base), start, start + window) for base in (BASE, BASE2)]
                row = words.doc[start]
                lo = start - words.first[row]
                first, which = _first_of((keys[0], keys[1]), (_order(part.column(0))[row], lo))
                doc_id, row_id = part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))
                keys[0] = np.where(first, keys[0], _scattered(row_id, lo))
                columns = [pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64), mask=~first), doc_id, row_id, pa.array(lo), *_sources(first, which, doc_id, row_id, lo)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "key2", "doc_id", "row_id", "lo", *_SOURCE])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of each text (a list of lo, hi and source) as ranges: those that lie on from one another in one source are one."""
    for batch in batches:
        seeds = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), seeds.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = seeds.flatten()
        lo, hi, src_doc, src_row, src_lo = (flat.field(k) for k in range(5))
        known = src_doc.is_null().to_numpy(zero_copy_only=False)
        number = lambda c: c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high, sd, sr, sl = map(number, (lo, hi, src_doc, src_row, src_lo))
        by = np.lexsort((low, sl - low, known, sd, sr, row))
        low, high, sl = low[by], high[by], sl[by]
        new = np.ones(len(by), bool)
        together = np.ones(max(0, len(by) - 1), bool)
        for c in (row[by], sr[by], sd[by], known[by], sl - low):
            together &= c[1:] == c[:-1]
        # Within a source and diagonal, seeds are in order of their starts and may overlap or nest.
        reach = high.copy()
        group = np.cumsum(np.append(True, ~together)) - 1 if len(by) else np.empty(0, np.int64)
        if len(by):
            shift = group * (int(high.max()) + 2)
            reach = np.maximum.accumulate(high + shift) - shift
            new[1:] = ~together | (low[1:] > reach[:-1] + 1)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(by)) - 1
        source = pa.array(by[start])
        found = pa.StructArray.from_arrays([pa.array(low[start]), pa.array(reach[last] if len(by) else low[start]), src_doc.take(source), src_row.take(source), pa.array(sl[start])], fields=list(_RANGE))
        offsets = np.append(0, np.cumsum(np.bincount(row[by][start], minlength=batch.num_rows))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), found)], names=["doc_id", "row_id", "ranges"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each text (doc_id, row_id, text, blocks) that are asked for, as (src_doc, src_row, block, body)."""
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column(2))
            asked = part.column(3)
            row = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            block = asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = words.count[row]
            first = np.minimum(block * BLOCK_WORDS, n) + words.first[row]
            last = np.minimum((block + 1) * BLOCK_WORDS, n) + words.first[row]
            body = [_text(words, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(block), pa.array(body, pa.binary())], names=["src_doc", "src_row", "block", "body"])


def _text(words: Words, first: int, last: int) -> bytes:
    """Words ``first`` to ``last`` (exclusive, of the chunk), joined by one space."""
    if first >= last:
        return b""
    raw = words.raw[words.start[first] : words.end[last - 1]].tobytes()
    return b" ".join(raw.split())


def extended(own: list[bytes], source: list[bytes], lo: int, size: int, src_lo: int, src_first: int) -> tuple[int, int, int]:
    """(start, length, source start) of the match around ``own[lo:lo + size]``, which should lie at ``src_lo`` of the source.

    ``source`` holds the source's words from ``src_first`` on. The match ends where words differ; where all agree it goes
    on to either side while they do, up to ``MARGIN`` words.
    """
    at = src_lo - src_first
    if own[lo : lo + size] != source[at : at + size]:
        end = next((k for k, (x, y) in enumerate(zip(own[lo : lo + size], source[at : at + size], strict=False)) if x != y), min(len(own) - lo, len(source) - at))
        return lo, end, src_lo
    right = _agreeing(own[lo + size : lo + size + MARGIN], source[at + size : at + size + MARGIN])
    left = _agreeing(own[max(0, lo - MARGIN) : lo][::-1], source[max(0, at - MARGIN) : at][::-1])
    return lo - left, left + size + right, src_lo - left


def _agreeing(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists begin with in common."""
    if a == b:
        return len(a)
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def greedy_factors(matches: list[tuple], window: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The factors of a text from its matches (start, length, source start, source), and the ranges of window starts that are repeats.

    At each place the match that reaches furthest is the factor, from that place on; where no match of ``window`` words
    goes on, the parse moves to the next one's start. Windows across a factor's end are repeats if any match holds them.
    """
    long = sorted((m for m in matches if m[1] >= window), key=lambda m: (m[0], -m[1]))
    factors, at, k, best = [], 0, 0, None
    while True:
        while k < len(long) and long[k][0] <= at:
            if best is None or long[k][0] + long[k][1] > best[0] + best[1]:
                best = long[k]
            k += 1
        if best is not None and best[0] + best[1] - at >= window:
            factors.append((at, best[0] + best[1] - at, best[2] + at - best[0], *best[3:]))
            at = best[0] + best[1]
        elif k < len(long):
            at = long[k][0]
        else:
            break
    # What all matches hold, as disjoint ranges of window starts in order.
    held: list[list[int]] = []
    for a, n, *_ in long:
        if held and a <= held[-1][1] + 1:
            held[-1][1] = max(held[-1][1], a + n - window)
        else:
            held.append([a, a + n - window])
    lows = [a for a, _ in held]
    repeats = []
    for a, n, *_ in factors:
        repeats.append((a, a + n - window))
        end = a + n
        j = max(0, bisect.bisect_right(lows, end - window + 1) - 1)
        while j < len(held) and held[j][0] < end:
            low, high = max(held[j][0], end - window + 1), min(held[j][1], end - 1)
            if low <= high:
                repeats.append((low, high))
            j += 1
    return factors, repeats


def _repeats(words: Words, row: int, ranges: list[dict], bodies: list[dict], window: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The parse of one text by its ranges and reference blocks: factors (start, length, source start, source doc_id, source row), repeats."""
    own = _text(words, words.first[row], words.first[row + 1]).split(b" ")
    known = {(x["src_doc"], x["src_row"], x["block"]): x["body"] for x in bodies}
    sources: dict[tuple, list[bytes]] = {}
    matches = []
    for r in ranges:
        size, src_lo, name = r["hi"] - r["lo"] + window, r["src_lo"], (r["src_doc"], r["src_row"])
        low, high = max(0, src_lo - MARGIN) // BLOCK_WORDS, (src_lo + size + MARGIN) // BLOCK_WORDS
        if (*name, low) not in known:
            # A text that repeats itself is its own reference.
            source, first = own, 0
        else:
            if (*name, low, high) not in sources:
                sources[*name, low, high] = [w for k in range(low, high + 1) if (body := known.get((*name, k))) for w in body.split(b" ")]
            source, first = sources[*name, low, high], low * BLOCK_WORDS
        start, n, at = extended(own, source, r["lo"], size, src_lo, first)
        matches.append((start, n, at, *name))
    return greedy_factors(matches, window)


def _pylist(column: pa.Array, row: int) -> list[dict]:
    return column[row].as_py() or []


def _cut_out(window: int, with_text: bool):
    """What is left of each text (columns: kept columns, text, ranges, bodies), its digest and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                n = part.num_columns - 3
                words = Words(part.column(n))
                ranges, bodies = part.column(n + 1), part.column(n + 2)
                marks = np.zeros(len(words.doc) + 1, np.int64)
                for row in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    _, repeats = _repeats(words, row, _pylist(ranges, row), _pylist(bodies, row), window)
                    first = words.first[row]
                    for lo, hi in repeats:
                        marks[first + lo] += 1
                        marks[first + hi + window] -= 1
                drop = np.cumsum(marks)[:-1] > 0
                removed = np.bincount(words.doc[drop], minlength=words.n_docs)
                kept = _joined(words, ~drop)
                texts = [hashlib.sha256(t).hexdigest() for t in kept]
                extra = [pa.array([t.decode("utf-8", "replace") for t in kept])] if with_text else []
                columns = [part.column(k) for k in range(n)] + [pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())] + extra
                names = part.schema.names[:n] + ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _factor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                words, out = Words(part.column(1)), []
                for row in range(part.num_rows):
                    for start, n, src_start, src_doc, _ in _repeats(words, row, _pylist(part.column(2), row), _pylist(part.column(3), row), window)[0]:
                        out.append((part.column(0)[row].as_py(), start, n, src_doc, src_start))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "source_doc_id", "source_start"])

    return run


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space."""
    size = (words.end - words.start)[keep] + 1
    start, doc = words.start[keep], words.doc[keep]
    ahead = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(ahead, size)
    source = place + np.repeat(start, size)
    out = np.full(len(source), 0x20, np.uint8)
    inner = place < np.repeat(size - 1, size)
    out[inner] = words.raw[source[inner]]
    data = out.tobytes()
    total = np.bincount(doc, size, words.n_docs).astype(np.int64)
    end = np.cumsum(total)
    return [data[b - n : b - 1] if n else b"" for n, b in zip(total.tolist(), end.tolist(), strict=True)]


def _at_rows(texts: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """``texts`` with what ``others`` has for their rows; a row is named by doc_id and a hash of its text."""
    rest = [c for c in others.columns if c not in ("doc_id", "row_id")]
    others = others.select(F.col("doc_id").alias("__doc_id"), F.col("row_id").alias("__row_id"), *rest)
    return texts.join(others, (F.col("row_id") == F.col("__row_id")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), how).drop("__doc_id", "__row_id")


def _dealt(listed: DataFrame) -> DataFrame:
    """Candidates with ``hot``, and with a key of anchor and words for anchor where that is so.

    Settled candidates have arbitrary anchors and don't count. The counts have ``ROUTES`` rows at most, so one task
    compares them and the hot ones are broadcast.
    """
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(ROUTES))
    counts = listed.where("words IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    over = counts.withColumn("mean", F.avg("n").over(Window.partitionBy())).where(F.col("n") > HOT * F.col("mean"))
    dealt = listed.join(F.broadcast(over.select("bucket", F.lit(True).alias("hot"))), bucket == F.col("bucket"), "left").drop("bucket")
    dealt = dealt.withColumn("hot", F.col("hot").isNotNull())
    return dealt.withColumn("anchor", F.when(F.col("hot"), F.xxhash64("anchor", "words")).otherwise(F.col("anchor")))


def seeds(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, list[str]]:
    """(doc_id, row_id, lo, hi, source) of all ranges of windows in ``texts`` (doc_id, row_id, text) that begin earlier elsewhere, and tables to discard."""
    spark = texts.sparkSession
    paths = [fresh_path(spark, n) for n in ("candidates", "windows")]
    anchors = fresh_path(spark, "anchors")
    stored(texts.mapInArrow(_factors(window, anchor), _FACTOR_DDL), anchors)
    listed = spark.read.schema(_FACTOR_DDL).parquet(anchors)
    same = Window.partitionBy("anchor", "words").orderBy("doc_id", "lo")
    lo = F.expr(f"span DIV {window}")

    def judged(rows: DataFrame, by: Window, settled: F.Column) -> DataFrame:
        """``rows`` with ``later`` and, where it holds, their source."""
        first = F.first(F.struct(F.col("doc_id").alias("src_doc"), F.col("row_id").alias("src_row"), F.col("lo").alias("src_lo"))).over(by)
        rows = rows.withColumns({"__rank": F.rank().over(by), "__first": first})
        own = F.struct(*_SOURCE)
        rows = rows.withColumns({"later": settled | (F.col("__rank") > 1), "__src": F.when(settled, own).otherwise(F.col("__first"))})
        return rows.drop(*_SOURCE, "__rank", "__first").select("*", *[F.when(F.col("later"), F.col("__src")[c]).alias(c) for c in _SOURCE]).drop("__src")

    found = _dealt(listed).repartition("anchor").withColumns({"lo": lo, "hi": lo + F.col("span") % window})
    entry = Window.partitionBy("anchor")
    found = judged(found, same, F.col("words").isNull()).withColumn("mixed", F.col("hot") | (F.min("words").over(entry) < F.max("words").over(entry)))
    found = found.where("later OR mixed").select("doc_id", "row_id", "lo", "hi", "later", *_SOURCE)
    stored(found, paths[0])
    discard(spark, anchors)
    found = spark.read.schema(found.schema).parquet(paths[0])
    edges = found.where("NOT later").groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    parsed = _at_rows(texts, edges, "inner").select("doc_id", "row_id", "text", "spans").mapInArrow(_windows(window), _SPAN_DDL).repartition("key")
    single = judged(parsed, Window.partitionBy("key", "key2").orderBy("doc_id", "lo"), F.col("key2").isNull()).where("later")
    single = single.select("doc_id", "row_id", "lo", F.col("lo").alias("hi"), *_SOURCE)
    stored(single, paths[1])
    single = spark.read.schema(single.schema).parquet(paths[1])
    return found.where("later").select("doc_id", "row_id", "lo", "hi", *_SOURCE).unionByName(single), paths


def with_references(texts: DataFrame, how: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``texts`` with ``ranges`` and ``bodies``: what of each text begins earlier elsewhere, and the reference blocks that this points into.

    A block is listed once for each text that refers to it. Both are tables of their own in the shared folder; all that
    led to them is removed.
    """
    spark = texts.sparkSession
    found, paths = seeds(texts, window, anchor)
    listed = found.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("lo", "hi", *_SOURCE)).alias("seeds"))
    ranges = table(listed.mapInArrow(_ranges, _RANGES_DDL), "ranges")
    discard(spark, *paths)
    flat = ranges.select("doc_id", "row_id", F.explode("ranges").alias("r")).select("doc_id", "row_id", "r.*")
    within = (F.col("src_row") == F.col("row_id")) & F.col("src_doc").eqNullSafe(F.col("doc_id"))
    block = F.explode(F.sequence(F.expr(f"greatest(0, src_lo - {MARGIN}) DIV {BLOCK_WORDS}"), F.expr(f"(src_lo + hi - lo + {window + MARGIN}) DIV {BLOCK_WORDS}")))
    asked = flat.where(~within).select("doc_id", "row_id", "src_doc", "src_row", block.alias("block")).distinct()
    wanted = asked.groupBy(F.col("src_doc").alias("doc_id"), F.col("src_row").alias("row_id")).agg(F.collect_set("block").alias("blocks"))
    blocks = _at_rows(texts, wanted, "inner").select("doc_id", "row_id", "text", "blocks").mapInArrow(_blocks, "src_doc long, src_row long, block long, body binary")
    # Rows that share doc_id and text are one source.
    path = fresh_path(spark, "reference-blocks")
    stored(blocks.dropDuplicates(["src_doc", "src_row", "block"]), path)
    blocks = spark.read.schema(blocks.schema).parquet(path).alias("b")
    same = (F.col("a.src_row") == F.col("b.src_row")) & F.col("a.src_doc").eqNullSafe(F.col("b.src_doc")) & (F.col("a.block") == F.col("b.block"))
    joined = asked.alias("a").join(blocks, same).select("a.*", "b.body")
    bodies = table(joined.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("src_doc", "src_row", "block", "body")).alias("bodies")), "references")
    discard(spark, path)
    return _at_rows(_at_rows(texts, ranges, how), bodies, "left")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, row_id (a hash that tells rows of one doc_id apart), text."""
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(7)).alias("row_id"), "text")


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The parse: doc_id, start, length, source_doc_id, source_start of each factor of ``window`` words or more."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    joined = with_references(texts, "inner", window, anchor).select("doc_id", F.col("text").alias("__text"), F.col("ranges").alias("__ranges"), F.col("bodies").alias("__bodies"))
    return joined.mapInArrow(_factor_rows(window), "doc_id long, start long, length long, source_doc_id long, source_start long")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """For each document doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for).

    Needs doc_id and text; other columns are ignored. Null and blank texts have no words. A null doc_id comes before
    all others. Rows that share a doc_id count as one document in what is earlier: the smaller start is kept, and rows
    that start a window at the same place both keep it. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = _texts(docs)
    joined = with_references(texts, "left", window, anchor).select("doc_id", F.col("text").alias("__text"), F.col("ranges").alias("__ranges"), F.col("bodies").alias("__bodies"))
    return joined.mapInArrow(_cut_out(window, with_text), "doc_id long, " + _KEPT_DDL + ", kept_text string" * with_text)
