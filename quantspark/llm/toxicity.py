"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are rates: weighted density of a lexicon, hits, distinct hits, hits close to second-person words, hits in
words that hide letters (l.i.k.e t-h*is), capitals, shouted words, punctuation, exclamation marks, words with inner
signs or digits, long runs of a letter, word length. Words are compared by their letters alone, in lower case, and once
more with the digits and signs that stand for letters read as these (``1d10t``).

Training data is a bounded sample, ``MAX_LABELLED`` rows of labels chosen by a hash of doc_id among those that may be
learned from. One half gives the lexicon: whole words and beginnings of words (stems) that mark toxic texts, ranked by
a pessimistic log-odds ratio over all words of the half; all that are well above even are kept. The other half gives
trees and, from out-of-fold scores, the isotonic map; so neither sees its own lexicon's luck. All documents are then scored in
one scan, without a shuffle; what is sent to executors is the lexicon and the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.store import cut
from quantspark.llm.words import BASE, BYTE_VALUES, Words, chunks, mix, powers
from quantspark.session import ship

MAX_LABELLED = 12_000
STEMS = range(3, 9)
NEAR = 5
#: Second-person words of the corpus's languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer eure sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra"

#: Common insults, with which every lexicon begins (fixed values).
INSULTS = "idiot idiots stupid moron morons dumb dumbass fool loser losers trash garbage scum pathetic worthless useless disgusting clown clowns jerk ugly freak creep bastard bitch asshole retard pig filth vermin dummkopf arschloch abschaum idiota estúpido imbécil basura connard salaud crétin ordure"
INSULT_WEIGHT = 2.0

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[0x80:] = True
#: What digits and signs stand for in place of letters (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LEET = _LOWER.copy()
for _sign, _meant in LEET.items():
    _LEET[ord(_sign)] = ord(_meant)
_STANDS_IN = _LEET != _LOWER
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

FEATURES = ("density", "hits", "distinct", "heaviest", "near_second", "hidden", "capitals", "shouted", "punctuation", "exclamation", "inner_signs", "runs", "word_length", "log_words")


@dataclass
class Letters:
    """The words of a chunk by their letters: a hash of the whole word, and of each stem, with the word it is of."""

    words: Words
    leet: bool = False
    whole: np.ndarray = field(init=False)
    stems: list[tuple[np.ndarray, np.ndarray]] = field(init=False)
    inner: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        words, raw = self.words, self.words.raw
        n = len(words.start)
        size = words.end - words.start
        word_of = np.repeat(np.arange(n), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.start, size)
        letter = _LETTER[raw[at]]
        if self.leet:
            # Only inside words that have a letter as well; a number stays a number, and a sign at the end a sign.
            mixed = np.bincount(word_of[letter], minlength=n) > 0
            inside = at < words.end[word_of] - 1
            letter |= _STANDS_IN[raw[at]] & mixed[word_of] & inside
        at, owner = at[letter], word_of[letter]
        low = (_LEET if self.leet else _LOWER)[raw[at]]
        # Latin-1 capitals are C3 80..9E in UTF-8, small letters C3 A0..BE.
        if len(at):
            follows = np.append(False, (raw[at[1:] - 1] == 0xC3)) & (low >= 0x80) & (low <= 0x9E)
            low = np.where(follows, low + 32, low).astype(np.uint8)
        n_letters = np.bincount(owner, minlength=n)
        first = np.cumsum(n_letters) - n_letters
        place = np.arange(len(at)) - first[owner]
        sums = np.zeros(len(at) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUES[low] * powers(BASE, int(n_letters.max(initial=1)))[place], out=sums[1:])
            self.whole = mix(sums[first + n_letters] - sums[first]) * (n_letters > 0).astype(np.uint64)
            starts = (low & 0xC0) != 0x80
            char = np.cumsum(starts) - 1
            char -= char[np.minimum(first, len(char) - 1)][owner] if len(char) else 0
            self.stems = []
            for k in () if self.leet else STEMS:
                end = np.flatnonzero(starts & (char == k))
                self.stems.append((mix((sums[end] - sums[first[owner[end]]]) ^ _U(k)), owner[end]))
        # Signs or digits between letters of a word.
        self.inner = np.zeros(n, bool)
        if len(at):
            has = n_letters > 0
            last = at[(first + n_letters - 1)[has]]
            self.inner[has] = last - at[first[has]] + 1 > n_letters[has]


def word_hash(word: str) -> int:
    """The hash that ``Letters.whole`` gives to a word."""
    return int(Letters(Words(pa.array([word]))).whole[0])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, in how many toxic and other texts each word and stem is."""
    for batch in batches:
        for part in chunks(batch):
            letters = Letters(Words(part.column(0)))
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            doc = letters.words.doc
            keys = np.concatenate([letters.whole, *[h for h, _ in letters.stems]])
            owner = np.concatenate([doc, *[doc[w] for _, w in letters.stems]])
            _, once = np.unique(keys ^ mix(owner.astype(np.uint64)), return_index=True)
            keys, owner = keys[once], owner[once]
            distinct, index = np.unique(keys, return_inverse=True)
            bad = np.bincount(index, toxic[owner], len(distinct)).astype(np.int64)
            every = np.bincount(index, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(every - bad)], names=["key", "bad", "good"])


def seed_lexicon() -> dict[int, float]:
    return {word_hash(w): INSULT_WEIGHT for w in INSULTS.split()}


def upper_starts(raw: np.ndarray) -> np.ndarray:
    """Marks of the last byte of each capital: ASCII, and Latin-1's two-byte ones (C3 80..9E without 97)."""
    upper = _UPPER[raw]
    if len(raw) > 1:
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return upper


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and stems (ascending) and their weights, from rows (text, toxic)."""
    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_bad, n = totals[0] or 0, totals[1]
    known = seed_lexicon()
    if not 0 < n_bad < n:
        return _sorted(known)
    tally = sample.select("text", "toxic").mapInArrow(_tally, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n - n_bad + 1.0))
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = tally.where("bad >= 3").select("key", (odds - 1.0 * doubt).alias("weight")).where("weight > 1.0").collect()
    known |= {int(np.int64(key).view(np.uint64)): weight for key, weight in best}
    return _sorted(known)


def _sorted(lexicon: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = sorted(lexicon)
    return np.array(keys, np.uint64), np.array([lexicon[k] for k in keys], float)


def features(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray], second: np.ndarray) -> np.ndarray:
    """The matrix of FEATURES of a chunk of texts."""
    letters = Letters(Words(column))
    words, keys, weights = letters.words, *lexicon
    n, raw, doc = words.n_docs, words.raw, words.doc

    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n) if len(doc) else np.zeros(n)

    weight = np.zeros(len(doc))
    named = np.zeros(len(doc), np.uint64)
    if len(keys):
        seen_through = Letters(words, leet=True).whole
        every = np.arange(len(doc))
        for found, owner in ((letters.whole, every), (seen_through, every), *letters.stems):
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = (keys[at] == found) & (weights[at] > weight[owner])
            weight[owner[hit]] = weights[at[hit]]
            named[owner[hit]] = found[hit]
    hit = weight > 0
    you = np.isin(letters.whole, second)
    close = np.zeros(len(doc), bool)
    for shift in range(1, NEAR + 1):
        same = doc[shift:] == doc[:-shift]
        close[shift:] |= you[:-shift] & same
        close[:-shift] |= you[shift:] & same
    some = np.maximum(1, words.count)
    distinct = np.bincount(doc[hit][np.unique(named[hit] ^ mix(doc[hit].astype(np.uint64)), return_index=True)[1]], minlength=n)
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, doc[hit], weight[hit])
    size = words.end - words.start
    capital = upper_starts(raw)
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(capital, out=upper[1:])
    shouted = (upper[words.end] - upper[words.start]) * 2 > size
    shouted &= size > 1
    runs = np.zeros(len(raw), bool)
    if len(raw) > 2:
        runs[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTER[raw[2:]]
        # The first two bytes of a row follow another row's.
        starts = words.at[:-1]
        for k in (0, 1):
            runs[(starts + k)[starts + k < words.at[1:]]] = False
    chars = np.maximum(1, np.diff(words.at))
    return np.column_stack([
        per(weight) / some, np.log1p(per(hit)), distinct, heaviest, per(hit & close) / some, per(hit & letters.inner),
        words.per_doc(capital) / chars, per(shouted) / some, words.per_doc(_PUNCT[raw]) / chars, words.per_doc(raw == ord("!")) / some,
        per(letters.inner) / some, words.per_doc(runs) / chars, per(size) / some, np.log1p(words.count),
    ])


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the log-odds, fitted by second-order gradients over binned features."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.1
    bins: int = 32
    least: float = 0.5
    ridge: float = 2.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]
        score = np.full(len(y), self.base)
        self.splits, self.leaves = [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                splits.append(self._split(node, 1 << level, binned, edges, grad, hess))
                feature, limit = splits[-1]
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > limit[node])
            g = np.bincount(node, grad, 1 << self.depth)
            h = np.bincount(node, hess, 1 << self.depth)
            leaf = -self.rate * g / (h + self.ridge)
            score += leaf[node]
            self.splits.append(splits)
            self.leaves.append(leaf)
        return self

    def _split(self, node, n_nodes, binned, edges, grad, hess):
        feature, limit, best = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf), np.zeros(n_nodes)
        for f, (b, e) in enumerate(zip(binned, edges, strict=True)):
            if not len(e):
                continue
            width = len(e) + 1
            g = np.bincount(node * width + b, grad, n_nodes * width).reshape(n_nodes, width).cumsum(1)
            h = np.bincount(node * width + b, hess, n_nodes * width).reshape(n_nodes, width).cumsum(1)
            gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
            gain[(hl < self.least) | (ht - hl < self.least)] = 0
            at = gain.argmax(1)
            top = gain[np.arange(n_nodes), at]
            better = top > best + 1e-9
            best[better], feature[better], limit[better] = top[better], f, e[at[better]]
        return feature, limit

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, limit in splits:
                node = 2 * node + (x[rows, feature[node]] > limit[node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising map from scores to rates (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, n, s_sum = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, blocks[-1][2] + s_sum]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    second: np.ndarray
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.knots[1][0])
        raw = self.trees.score(features(column, self.lexicon, self.second))
        rate = np.interp(raw, *self.knots)
        # A little of the uncalibrated score keeps the order within a step of the map.
        return np.clip(0.995 * rate + 0.005 / (1 + np.exp(-raw)), 0.0, 1.0)


def _fit(x: np.ndarray, y: np.ndarray, folds: int = 5) -> tuple[Trees | None, tuple[np.ndarray, np.ndarray]]:
    if not len(y) or y.min() == y.max():
        return None, (np.zeros(1), np.array([(y.sum() + 0.5) / (len(y) + 1.0)]))
    fold = np.random.Generator(np.random.PCG64(5)).integers(0, folds, len(y))
    held = np.zeros(len(y))
    for k in range(folds):
        out = fold == k
        held[out] = Trees().fit(x[~out], y[~out]).score(x[out])
    return Trees().fit(x, y), isotonic(held, y)


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model from at most about ``most`` labelled rows that are not held out.

    Labels that are null count as missing; of several labels of a doc_id the largest counts; of rows that share
    a doc_id one is learned from, that with the least hash of its text; null texts are empty ones. With no labels, of one kind only, or without
    documents the model is a constant rate. Other columns are ignored. The lexicon holds words of the sample alone, so
    its size is bounded as the sample is.
    """
    ship(docs.sparkSession)
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    n = may.count()
    share = min(1.0, most / max(1, n))
    chosen = may.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row for each doc_id, so that the sample is bounded whatever the table repeats.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = cut(rows.select("text", "toxic", half.alias("half"), F.xxhash64("doc_id", F.lit(13)).alias("place")))
    lexicon = learn_lexicon(rows.where("half = 0"))
    second = np.array([word_hash(w) for w in SECOND_PERSON.split()], np.uint64)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = features(part.column(0), lexicon, second)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *[pa.array(c) for c in x.T]], names=["toxic", "place", *FEATURES])

    ddl = "toxic int, place long, " + ", ".join(f"{f} double" for f in FEATURES)
    table = rows.where("half = 1").select("text", "toxic", "place").mapInArrow(measured, ddl).toPandas().sort_values(["place", *FEATURES])
    trees, knots = _fit(table[list(FEATURES)].to_numpy(float), table["toxic"].to_numpy(float))
    return Model(lexicon, second, trees, knots)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Null and empty texts have the score of a text without words. A row's score follows from its text alone, so repeated
    rows agree; null doc_ids are rows like any other; other columns are ignored; an empty table gives an empty result.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = model.score(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out().alias("held_out"), "text")
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that is trained on labels of documents that are not held out."""
    return score(docs, train(docs, labels))
