"""Tags and trees of sentences: a hidden Markov tagger fitted by counts, and the best projective tree.

No annotated text is at hand, so the tagger's counts come from a corpus whose words carry the tags of simple rules; what
it adds is context: a word of several uses gets the tag that fits its neighbours, an unknown one that of its ending and
place. Trees maximise the sum of scores of their arcs, which follow from tags, direction and distance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "ADP", "DET", "PRON", "NUM", "CCONJ", "SCONJ", "PUNCT")
_AT = {t: k for k, t in enumerate(TAGS)}
#: Words that a tagger knows by themselves: the most frequent ones of its corpus; others go by their form.
MAX_WORDS = 20_000
LEAST_COUNT = 5
_ENDINGS = ("ing", "ed", "ly", "tion", "ment", "ness", "ity", "er", "est", "ous", "ful", "al", "ic", "ive", "able", "s", "en", "y", "e")


def form(word: str, first: bool) -> str:
    """The class of a word that isn't known by itself: its kind of letters, place and ending."""
    if word[:1].isdigit():
        return "#digits"
    if not word[:1].isalpha():
        return "#sign"
    case = "upper" if word[0].isupper() and not first else "first" if first else "lower"
    return f"#{case}-{next((e for e in _ENDINGS if word.lower().endswith(e)), '')}"


@dataclass(frozen=True)
class Tagger:
    """Logarithms of probabilities: of a tag after a tag (the last row: at the start), and of a word or form given a tag."""

    after: np.ndarray
    word: dict[str, np.ndarray]
    unknown: np.ndarray

    def emission(self, word: str, first: bool) -> np.ndarray:
        known = self.word.get(word.lower())
        return known if known is not None else self.word.get(form(word, first), self.unknown)

    def tags(self, words: list[str]) -> list[str]:
        """The most probable tags (Viterbi); of equals the first in the order of TAGS."""
        if not words:
            return []
        score, back = self.after[-1] + self.emission(words[0], True), []
        for w in words[1:]:
            step = score[:, None] + self.after[:-1]
            back.append(step.argmax(0))
            score = step.max(0) + self.emission(w, False)
        path = [int(score.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return [TAGS[k] for k in reversed(path)]


def tagger(transitions: dict[tuple[str, str], int], emissions: dict[tuple[str, str], int]) -> Tagger:
    """A tagger from counts of (tag or "", next tag) and of (tag, word or form), with one added to each."""
    n = len(TAGS)
    after = np.ones((n + 1, n))
    for (a, b), count in transitions.items():
        after[_AT.get(a, n), _AT[b]] += count
    total = np.ones(n)
    rows: dict[str, np.ndarray] = {}
    for (t, w), count in emissions.items():
        rows.setdefault(w, np.zeros(n))[_AT[t]] += count
        if not w.startswith("#"):
            total[_AT[t]] += count
    forms = {w for w in rows if w.startswith("#")}
    norm = total + len(rows)
    words = {w: np.log((c + 0.1) / norm) for w, c in rows.items() if w not in forms}
    # A form stands for the words of it that aren't known: it may have a tag as often as all its words have it.
    words |= {w: np.log((rows[w] + 0.1) / norm) for w in forms}
    return Tagger(np.log(after / after.sum(1, keepdims=True)), words, np.log(1 / norm))


def fit(texts: DataFrame, column: str = "text", most: int = MAX_WORDS) -> Tagger:
    """A tagger from all sentences of ``texts``.

    Tasks count tags in a row, forms, and words with their tags. Transitions and forms are a few hundred rows; of words
    the ``most`` frequent ones with ``LEAST_COUNT`` occurrences are collected, so what reaches the driver is bounded.
    """
    from quantspark.functions.text import sentence_spans
    from quantspark.functions.spans import substring
    from quantspark.session import ship

    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quantspark.operators.annotate import rule_tags, split_words

        for batch in batches:
            counts: Counter = Counter()
            for sentence in batch.column(0).to_pylist():
                words = [sentence[a:b] for a, b in split_words(sentence or "")]
                tags = rule_tags(words)
                counts.update(("after", a, b) for a, b in zip(["", *tags], tags, strict=False))
                counts.update(("word", t, w.lower()) for t, w in zip(tags, words, strict=True))
                counts.update(("form", t, form(w, k == 0)) for k, (t, w) in enumerate(zip(tags, words, strict=True)))
            kind, a, b = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts.values(), pa.int64())], ["kind", "a", "b", "n"])

    split = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("t"), F.explode(sentence_spans(column)).alias("s"))
    counted = split.select(substring(F.col("t"), F.col("s")).alias("sentence")).mapInArrow(run, "kind string, a string, b string, n long")
    counted = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    few = counted.where("kind <> 'word'").collect()
    frequent = counted.where("kind = 'word'").groupBy("b").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("tags"))
    known = frequent.where(F.col("total") >= LEAST_COUNT).orderBy(F.desc("total"), "b").limit(most).collect()
    emissions = {(r.a, r.b): r.n for r in few if r.kind == "form"} | {(t, r.b): n for r in known for t, n in r.tags.items() if not r.b.startswith("#")}
    return tagger({(r.a, r.b): r.n for r in few if r.kind == "after"}, emissions)


#: How well a word of a tag hangs on one of another: (dependent, head, side of the head) and the score; UNUSUAL for all others.
_HANGS = {
    ("DET", "NOUN", "right"): 5.0, ("DET", "PROPN", "right"): 4.5, ("ADJ", "NOUN", "right"): 5.0, ("ADJ", "PROPN", "right"): 4.0, ("ADJ", "AUX", "left"): 3.0, ("ADJ", "VERB", "left"): 2.0,
    ("NUM", "NOUN", "right"): 5.0, ("NUM", "PROPN", "right"): 3.0, ("NUM", "ADP", "left"): 3.5, ("NUM", "VERB", "left"): 2.5, ("NUM", "AUX", "left"): 2.5, ("NUM", "NUM", "right"): 3.0,
    ("NOUN", "NOUN", "right"): 3.8, ("NOUN", "PROPN", "right"): 2.5, ("PROPN", "PROPN", "right"): 4.6, ("PROPN", "NOUN", "right"): 3.6,
    ("NOUN", "ADP", "left"): 4.8, ("PROPN", "ADP", "left"): 4.8, ("PRON", "ADP", "left"): 4.0,
    ("ADP", "NOUN", "left"): 3.0, ("ADP", "PROPN", "left"): 2.4, ("ADP", "NUM", "left"): 2.0, ("ADP", "VERB", "left"): 2.6, ("ADP", "AUX", "left"): 2.2, ("ADP", "VERB", "right"): 1.5, ("ADP", "AUX", "right"): 1.5, ("ADP", "ADJ", "left"): 2.0,
    ("NOUN", "VERB", "right"): 3.6, ("NOUN", "AUX", "right"): 3.6, ("PROPN", "VERB", "right"): 3.6, ("PROPN", "AUX", "right"): 3.6, ("PRON", "VERB", "right"): 3.8, ("PRON", "AUX", "right"): 3.8,
    ("NOUN", "VERB", "left"): 3.4, ("NOUN", "AUX", "left"): 3.2, ("PROPN", "VERB", "left"): 3.2, ("PROPN", "AUX", "left"): 3.0, ("PRON", "VERB", "left"): 3.0,
    ("VERB", "NOUN", "left"): 1.8, ("VERB", "VERB", "left"): 3.0, ("VERB", "AUX", "left"): 2.8, ("AUX", "VERB", "right"): 3.0, ("AUX", "AUX", "left"): 3.2, ("VERB", "SCONJ", "left"): 2.0,
    ("ADV", "VERB", "right"): 2.5, ("ADV", "ADJ", "right"): 3.4, ("ADV", "NUM", "right"): 3.6, ("ADV", "VERB", "left"): 2.4, ("ADV", "AUX", "left"): 2.4, ("ADV", "ADV", "right"): 2.6,
    ("CCONJ", "NOUN", "right"): 2.4, ("CCONJ", "PROPN", "right"): 2.4, ("CCONJ", "VERB", "right"): 2.2, ("CCONJ", "ADJ", "right"): 2.0, ("SCONJ", "VERB", "right"): 2.4, ("SCONJ", "AUX", "right"): 2.4,
    ("PUNCT", "VERB", "left"): 1.0, ("PUNCT", "AUX", "left"): 1.0, ("PUNCT", "NOUN", "left"): 0.8, ("PUNCT", "PROPN", "left"): 0.8,
}
_ROOT = {"VERB": 5.0, "AUX": 4.6, "NOUN": 2.0, "PROPN": 1.6, "NUM": 1.0, "ADJ": 0.8}
#: What each doubling of the distance costs, and what a sign on the way costs a dependent that is no sign.
_DISTANCE, _SIGN = 0.7, 1.2
UNUSUAL = -1.5
#: What a noun gains on the preposition that its phrase follows, and loses outside its phrase if a noun comes right after it.
_GOVERNED, _COMPOUND = 2.0, 3.0
_KIND = np.full((len(TAGS), len(TAGS), 2), UNUSUAL)
for (_d, _h, _side), _s in _HANGS.items():
    _KIND[_AT[_h], _AT[_d], 0 if _side == "left" else 1] = _s


_SIGN_WORDS = ",;:()"


def arc_scores(words: list[str], tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``score[head, dependent]`` of all pairs of words, and the score of each word as the root."""
    at = np.array([_AT[t] for t in tags], np.int64)
    n = len(at)
    i = np.arange(n)
    right = (i[:, None] > i[None, :]).astype(np.int64)
    score = _KIND[at[:, None], at[None, :], right] - _DISTANCE * np.log2(np.maximum(1, np.abs(i[:, None] - i[None, :])))
    signs = np.concatenate([[0], np.cumsum([w in _SIGN_WORDS for w in words])])
    between = np.abs(signs[np.maximum(i[:, None], i[None, :])] - signs[np.minimum(i[:, None], i[None, :]) + 1])
    score -= _SIGN * between * (at != _AT["PUNCT"])[None, :]
    _phrases(score, tags)
    return score, np.array([_ROOT.get(t, 0.0) for t in tags]) - 0.01 * i


def _phrases(score: np.ndarray, tags: list[str]) -> None:
    """Nouns within a noun phrase keep to it; its last noun keeps to the preposition before it."""
    nouns, ruler = ("NOUN", "PROPN"), None
    for k, tag in enumerate(tags):
        if tag not in ("DET", "ADJ", "NUM", "ADV", *nouns):
            ruler = k if tag == "ADP" else None
        if tag in nouns:
            if k + 1 < len(tags) and tags[k + 1] in nouns:
                end = next((j for j in range(k + 1, len(tags)) if tags[j] not in nouns), len(tags))
                score[:k, k] -= _COMPOUND
                score[end:, k] -= _COMPOUND
            elif ruler is not None:
                score[ruler, k] += _GOVERNED


def projective_tree(score: np.ndarray, root: np.ndarray) -> list[int]:
    """The heads of the projective tree with one root of the greatest total score; the root's head is itself.

    Eisner's programme over spans, all of one width at a time: ``open`` spans end in an arc between their ends, ``half``
    spans hold all that hangs on one end.
    """
    n = len(root)
    if n == 0:
        return []
    half = np.full((2, n, n), -math.inf)
    half[:, np.arange(n), np.arange(n)] = 0.0
    open_ = np.full((2, n, n), -math.inf)
    at_open, at_half = np.zeros((n, n), np.int64), np.zeros((2, n, n), np.int64)
    for width in range(1, n):
        s = np.arange(n - width)
        t = s + width
        r = s[:, None] + np.arange(width)
        # 0: the left end is the head; 1: the right end is.
        both = half[0][s[:, None], r] + half[1][r + 1, t[:, None]]
        at_open[s, t] = s + both.argmax(1)
        best = both.max(1)
        open_[0][s, t], open_[1][s, t] = best + score[s, t], best + score[t, s]
        to_left = half[1][s[:, None], r] + open_[1][r, t[:, None]]
        half[1][s, t], at_half[1][s, t] = to_left.max(1), s + to_left.argmax(1)
        to_right = open_[0][s[:, None], r + 1] + half[0][r + 1, t[:, None]]
        half[0][s, t], at_half[0][s, t] = to_right.max(1), s + 1 + to_right.argmax(1)
    top = int((half[1][0] + half[0][:, n - 1] + root).argmax())
    heads = list(range(n))
    todo = [("half", 1, 0, top), ("half", 0, top, n - 1)]
    while todo:
        kind, side, s, t = todo.pop()
        if s == t:
            continue
        if kind == "open":
            heads[t if side == 0 else s] = s if side == 0 else t
            r = int(at_open[s, t])
            todo += [("half", 0, s, r), ("half", 1, r + 1, t)]
        elif side == 1:
            r = int(at_half[1][s, t])
            todo += [("half", 1, s, r), ("open", 1, r, t)]
        else:
            r = int(at_half[0][s, t])
            todo += [("open", 0, s, r), ("half", 0, r, t)]
    return heads


@lru_cache(maxsize=16_384)
def _heads(tags: tuple[str, ...], signs: tuple[bool, ...]) -> tuple[int, ...]:
    return tuple(projective_tree(*arc_scores(["," if s else "w" for s in signs], list(tags))))


def heads_of(words: list[str], tags: list[str]) -> list[int]:
    """Heads follow from tags and from where signs stand, so trees of sentences of one shape are found once."""
    return list(_heads(tuple(tags), tuple(w in _SIGN_WORDS for w in words))) if words else []


_SIGNS, _INNER = frozenset("-+±√"), frozenset(["/", "^", "x", "e", "E"])
_APOSTROPHES = re.compile(r"\d+(?:['’]\d{3})+$")


def number_tokens(tokens: list[dict], ordinals: frozenset[str] | set[str] = frozenset()) -> list[tuple[int, int]]:
    """Runs of tokens (first, end) around those tagged as numbers: with signs, inner signs and ordinals beside them.

    A run neither begins nor ends in an inner sign, nor ends in a sign.
    """
    kinds = "".join("n" if t["pos"] == "NUM" and t["text"] != "°" else "s" if t["text"] in _SIGNS else "i" if t["text"] in _INNER else "o" if t["lemma"] in ordinals or _APOSTROPHES.match(t["text"]) else " " for t in tokens)
    found = []
    for m in re.finditer(r"[nsio]+", kinds):
        a, b = m.span()
        if "n" in m[0]:
            found.append((a + (kinds[a] == "i"), b - (kinds[b - 1] in "is")))
    return found
