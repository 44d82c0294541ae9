"""Phrases in lists of words: one Aho-Corasick automaton for all of them.

Words are numbered, and the automaton runs over numbers, so a word that is in no phrase costs one look-up and a text is
read once, however many phrases there are and however long. Only hits become rows. The automaton is built once in
each worker from a broadcast list, if that list is below ``MAX_SHIPPED``; more phrases are split by their first words
and joined with the places where a text has these.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions.formats import representations
from quantspark.operators.annotate import lemma, lemmas
from quantspark.session import ship

#: Phrases that are sent to every worker; about 20 MB.
MAX_SHIPPED = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Words whose lemma's number a worker remembers.
MAX_REMEMBERED = 500_000

HIT = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
_HIT = pa.struct([("phrase", pa.string()), ("first", pa.int32()), ("last", pa.int32())])


class Automaton:
    """Finds all phrases (sequences of words) in a list of words, overlapping ones too."""

    def __init__(self, phrases: Iterable[Sequence[str]]):
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        for k, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                n = self.number.setdefault(word, len(self.number))
                if n not in self.next[state]:
                    self.next[state][n] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                state = self.next[state][n]
            if state:
                self.ends[state] = (k, len(phrase))
        # Where to go on after a mismatch, and the nearest state on that way at which a phrase ends.
        self.back, self.shorter = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for n, child in self.next[state].items():
                at = self.back[state]
                while at and n not in self.next[at]:
                    at = self.back[at]
                at = self.next[at].get(n, 0)
                self.back[child] = at
                self.shorter[child] = at if self.ends[at] else self.shorter[at]
                queue.append(child)

    def found(self, numbers: Iterable[int | None]) -> list[tuple[int, int, int]]:
        """(phrase, first word, last word) of each hit, by last word, in a list of word numbers (None: in no phrase)."""
        out, state, following, back = [], 0, self.next, self.back
        for i, n in enumerate(numbers):
            if n is None:
                state = 0
                continue
            while state and n not in following[state]:
                state = back[state]
            state = following[state].get(n, 0)
            at = state if self.ends[state] else self.shorter[state]
            while at:
                k, size = self.ends[at]
                out.append((k, i - size + 1, i))
                at = self.shorter[at]
        return out


_BUILT: dict[str, tuple[Automaton, list[str], dict[str, int | None]]] = {}


def _built(token: str, shipped: Broadcast) -> tuple[Automaton, list[str], dict[str, int | None]]:
    """The automaton of a list of phrases, the phrases, and the worker's memory of text words; one is kept at a time."""
    if token not in _BUILT:
        _BUILT.clear()
        phrases = shipped.value
        _BUILT[token] = Automaton(p.split(" ") for p in phrases), phrases, {}
    return _BUILT[token]


def _numbers_of_words(words: list[str] | None, number: dict[str, int]) -> list[int | None]:
    return [number.get(w) for w in words or ()]


def _numbers_of_text(text: str | None, number: dict[str, int], known: dict[str, int | None]) -> list[int | None]:
    out = []
    for w in _WORD.findall((text or "").lower()):
        if w not in known:
            if len(known) >= MAX_REMEMBERED:
                known.clear()
            known[w] = number.get(lemma(w))
        out.append(known[w])
    return out


def matcher(phrases: DataFrame, texts: bool) -> Callable[[Column], Column] | None:
    """A column function from lists of words (or ``texts``, by the lemmas of their words) to an array of HIT.

    ``phrases`` has a column ``phrase``: words joined by spaces. None if there are more than ``MAX_SHIPPED``.
    """
    spark = phrases.sparkSession
    ship(spark)
    listed = phrases.select("phrase").where("phrase <> ''").distinct().limit(MAX_SHIPPED + 1).collect()
    if len(listed) > MAX_SHIPPED:
        return None
    shipped, token = spark.sparkContext.broadcast(sorted(r.phrase for r in listed)), uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(HIT))
    def run(column: pa.Array) -> pa.Array:
        automaton, names, known = _built(token, shipped)
        sizes, hits = [0], []
        for row in column.to_pylist():
            numbers = _numbers_of_text(row, automaton.number, known) if texts else _numbers_of_words(row, automaton.number)
            hits += automaton.found(numbers)
            sizes.append(len(hits))
        of, first, last = zip(*hits, strict=True) if hits else ((), (), ())
        structs = pa.StructArray.from_arrays([pa.array([names[k] for k in of], pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], fields=list(_HIT))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)

    return run


def hits_by_first_words(rows: DataFrame, keys: list[str], words: str, phrases: DataFrame) -> DataFrame:
    """``matcher`` for phrases that are too many to ship: (keys, phrase, first, last).

    An equi-join of the first word, or the first two of a longer phrase, with the places that have these; what follows
    is compared in the join. A place gives two rows, whatever the length of phrases.
    """
    parts = F.split("phrase", " ")
    head = F.when(F.size(parts) == 1, F.col("phrase")).otherwise(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    listed = phrases.select("phrase").where("phrase <> ''").distinct().select("phrase", head.alias("__head"), F.size(parts).alias("__n"), F.slice(parts, 3, 1 << 20).alias("__rest"))
    longest = listed.agg(F.max("__n")).first()[0] or 1
    w = F.col(words)
    places = rows.select(*keys, F.posexplode(F.transform(w, lambda x, i: F.struct(F.array(x, F.concat_ws(" ", x, F.get(w, i + 1))).alias("heads"), F.slice(w, i + 3, max(longest - 2, 0)).alias("after")))).alias("first", "p"))
    places = places.select(*keys, "first", F.posexplode("p.heads").alias("__k", "__head"), F.col("p.after").alias("__after"))
    same = (F.least("__n", F.lit(2)) == F.col("__k") + 1) & (F.slice("__after", F.lit(1), F.greatest(F.col("__n") - 2, F.lit(0))) == F.col("__rest"))
    joined = places.join(listed, "__head").where(same)
    return joined.select(*keys, "phrase", "first", (F.col("first") + F.col("__n") - 1).alias("last"))


def word_hits(rows: DataFrame, keys: list[str], words: str, phrases: DataFrame) -> DataFrame:
    """(keys, phrase, first, last): where lists of ``words`` hold one of ``phrases`` (phrase), one row for each hit."""
    match = matcher(phrases, False)
    if match is None:
        return hits_by_first_words(rows, keys, words, phrases)
    return rows.select(*keys, F.inline(match(F.col(words))))


def text_hits(rows: DataFrame, keys: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """The same for the lemmas of the words of a ``text``."""
    match = matcher(phrases, True)
    if match is None:
        listed = rows.select(*keys, F.explode(F.array(lemmas(F.col(text)))).alias("__words"))
        return hits_by_first_words(listed, keys, "__words", phrases)
    return rows.select(*keys, F.inline(match(F.col(text))))


#: What a stated value is parted into: runs of letters and digits, and single signs, without white space.
_PARTS = re.compile(r"[^\W_]+|[^\s\w]|_")
#: Strings of one automaton for stated values.
MAX_STATED = 60_000


def stated_spans(texts: list[str | None], values: list[list[float] | None], strings: Callable[[float], list[str]]) -> list[list[tuple[int, int, float]]]:
    """For each text the spans in which it states one of its values as one of their ``strings``, whatever the case.

    One automaton serves as many texts as have ``MAX_STATED`` strings, of which it holds those that a text with their
    value contains at all. Of hits that overlap the longer stays, then the
    earlier. A hit has no letter or digit right before or after it.
    """
    out: list[list[tuple[int, int, float]]] = []
    start = 0
    while start < len(texts):
        listed: dict[tuple[str, ...], set[tuple[str, float]]] = {}
        n, end = 0, start
        while end < len(texts) and (end == start or n < MAX_STATED):
            low = (texts[end] or "").lower()
            for value in values[end] or ():
                for s in strings(value) if value is not None else ():
                    if (s := s.lower()) in low:
                        listed.setdefault(tuple(_PARTS.findall(s)), set()).add((s, value))
                        n += 1
            end += 1
        phrases = list(listed)
        automaton = Automaton(phrases)
        for text, own in zip(texts[start:end], values[start:end], strict=True):
            out.append(_stated(text or "", set(own or ()), automaton, phrases, listed))
        start = end
    return out


def _stated(text: str, own: set[float], automaton: Automaton, phrases: list[tuple[str, ...]], listed: dict[tuple[str, ...], set[tuple[str, float]]]) -> list[tuple[int, int, float]]:
    low = text.lower()
    places = [m.span() for m in _PARTS.finditer(low)]
    numbers = [automaton.number.get(low[a:b]) for a, b in places]
    found = set()
    for k, first, last in automaton.found(numbers):
        a, b = places[first][0], places[last][1]
        found |= {(a, b, v) for s, v in listed[phrases[k]] if v in own and low[a:b] == s}
    kept: list[tuple[int, int, float]] = []
    for a, b, v in sorted(found, key=lambda h: (h[0] - h[1], h)):
        edge = (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum())
        if edge and not any(x < b and a < y for x, y, _ in kept):
            kept.append((a, b, v))
    return sorted(kept)


STATED = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.DoubleType())])


@F.pandas_udf(T.ArrayType(STATED))
def stated_values(texts: pd.Series, values: pd.Series) -> pd.Series:
    """The spans in which a text states one of its ``values`` (an array of doubles) in digits or words."""
    found = stated_spans(list(texts), [None if v is None else list(v) for v in values], representations)
    return pd.Series([[{"start": a, "end": b, "value": v} for a, b, v in spans] for spans in found])
