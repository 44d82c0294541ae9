"""Annotator: tokens with lemma, part of speech and head, entities, numbers by tags; each is a column that a task asks for.

Tags come from rules or a tagger that ``syntax.fit`` has fitted to a corpus, heads from the best projective tree. Another
annotator can take its place: a function from texts to the same token structs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions import vocab
from quantspark.functions.numbers import SPAN, date_spans, find_dates, merged, number_spans
from quantspark.operators.syntax import Tagger, heads_of, number_tokens

TOKEN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("lemma", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("head", T.IntegerType())])
TOKENS = T.ArrayType(TOKEN)

_TOKEN = re.compile(r"\d+(?:[.,]\d+|['’]\d{3}(?!\d))*|\w+(?:[-'’]\w+)*|[^\w\s]")
_CLOSED = {
    "ADP": "of in on at by for with from to into over under between about after before during through per than via within",
    "DET": "the a an this that these those its their his her our my your each every some any no",
    "PRON": "it he she they we i you who which what itself one",
    "CCONJ": "and or but nor",
    "SCONJ": "because although while if since when where whereas",
    "AUX": "is are was were be been being has have had do does did can could may might must shall should will would",
    "ADV": "not also very about approximately roughly nearly almost only just more most less least up around",
    "ADJ": "long high wide deep tall thick large small big total average maximum minimum new old first last main other",
    "VERB": "measures weighs covers reaches rises lies stands extends contains holds costs made built located recorded flows runs grew",
}
CLOSED = {w: pos for pos, words in _CLOSED.items() for w in words.split()}
_IRREGULAR = {"feet": "foot", "men": "man", "women": "woman", "people": "person", "children": "child", "inches": "inch", "was": "be", "were": "be", "is": "be", "are": "be", "has": "have", "had": "have"}
_ADJECTIVE = re.compile(r".*(?:ous|ful|less|able|ible|ical|ive|al|ic|ish|ary)$")
#: Labels that a number may be part of without being a quantity, and those an entity may grow into (fixed values).
NUMBER_WHITELIST = ("DATE", "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "TIME")
ENTITY_LABELS = ("PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE")


def lemma(word: str) -> str:
    """A lower-case lemma by suffix rules."""
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and re.search(r"(?:ss|x|ch|sh)es$", w):
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        return w[:-1]
    return w


def _pos(word: str, first: bool) -> str:
    low = word.lower()
    if re.match(r"\d", word) or low in vocab.cardinals() or low in vocab.magnitudes():
        return "NUM"
    if not re.match(r"\w", word):
        return "PUNCT"
    if low in CLOSED:
        return CLOSED[low]
    if word[0].isupper() and not first:
        return "PROPN"
    if low.endswith("ly"):
        return "ADV"
    if _ADJECTIVE.match(low):
        return "ADJ"
    return "NOUN"


def split_words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def rule_tags(words: list[str]) -> list[str]:
    return [_pos(w, k == 0) for k, w in enumerate(words)]


def tokens(text: str, tagger: Tagger | None = None) -> list[dict]:
    """Tokens with tags, by a ``tagger`` or else by rules, and the heads of the best projective tree; the root heads itself."""
    found = split_words(text)
    words = [text[a:b] for a, b in found]
    pos = rule_tags(words) if tagger is None else tagger.tags(words)
    return [{"start": a, "end": b, "text": w, "lemma": lemma(w), "pos": p, "head": h} for (a, b), w, p, h in zip(found, words, pos, heads_of(words, pos), strict=True)]


@F.pandas_udf(TOKENS)
def annotated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tokens(t or ""))


def annotated_by(tagger: Tagger):
    """``annotated`` with the tags of a fitted tagger."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: tokens(t or "", tagger)), TOKENS)


def lemma_of(word: Column) -> Column:
    """``lemma`` in SQL."""
    w = F.lower(word)
    irregular = F.create_map(*[F.lit(x) for pair in _IRREGULAR.items() for x in pair])
    size = F.length(w)
    plural = w.endswith("s") & ~w.rlike("(ss|us|is)$")
    by_rule = (
        F.when((size > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), size - 3), F.lit("y")))
        .when((size > 4) & w.rlike("(ss|x|ch|sh)es$"), F.substring(w, F.lit(1), size - 2))
        .when((size > 3) & plural, F.substring(w, F.lit(1), size - 1)).otherwise(w)
    )
    return F.coalesce(F.try_element_at(irregular, w), by_rule)


def lemmas(text: Column) -> Column:
    """The lower-case lemmas of a text's words, in SQL."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lemma_of)


def components(df: DataFrame, text: str, wanted: tuple[str, ...], tagger: Tagger | None = None) -> DataFrame:
    """``df`` with the annotations that a task asks for, and no others: tokens, numbers, dates, entities."""
    made = {"tokens": annotated if tagger is None else annotated_by(tagger), "numbers": number_spans, "dates": date_spans, "entities": whitelisted}
    return df.withColumns({name: made[name](text) for name in wanted})


def entities(text: str) -> list[tuple[int, int, str]]:
    """Dates and runs of proper nouns (with numbers inside them) as entities."""
    found = [(a, b, "DATE") for a, b in find_dates(text)]
    toks, k = tokens(text), 0
    while k < len(toks):
        j = k
        while j < len(toks) and (toks[j]["pos"] == "PROPN" or (j > k and toks[j]["pos"] == "NUM" and toks[j]["text"].isdigit() and len(toks[j]["text"]) < 4)):
            j += 1
        if j > k:
            found.append((toks[k]["start"], toks[j - 1]["end"], "ORG"))
        k = max(j, k + 1)
    return found


@F.pandas_udf(SPAN)
def whitelisted(texts: pd.Series) -> pd.Series:
    """Spans of entities in which a number is part of a name or date."""
    return texts.map(lambda t: [{"start": a, "end": b} for a, b, label in entities(t or "") if label in NUMBER_WHITELIST])


def count_noun(text: str, value: tuple[int, int], frequent: set[str] | frozenset[str], toks: list[dict] | None = None) -> tuple[int, int] | None:
    """The noun right of a numeral that is counted, with ``per NOUN`` after it; None if that noun is a frequent unit."""
    toks = tokens(text) if toks is None else toks
    after = [k for k, t in enumerate(toks) if t["start"] >= value[1]]
    if not after:
        return None
    k = after[0]
    if toks[k]["text"] in "(-":
        k += 1
    head = next((j for j in range(k, min(len(toks), k + 10)) if toks[j]["pos"] in ("NOUN", "PROPN")), None)
    if head is None or any(toks[j]["pos"] in ("VERB", "AUX", "PUNCT", "NUM") for j in range(k, head)):
        return None
    while head + 1 < len(toks) and toks[head + 1]["pos"] == "NOUN" and toks[head + 1]["start"] - toks[head]["end"] == 1:
        head += 1
    if toks[head]["lemma"] in frequent or toks[head]["text"].lower() in frequent:
        return None
    # NOUN per NOUN, or with a verb between that hangs on the noun: people killed per year.
    after, end = head + 1, head
    if after + 1 < len(toks) and toks[after]["head"] == head and (toks[after]["pos"] == "VERB" or toks[after]["text"].lower().endswith("ed")):
        after += 1
    if after + 1 < len(toks) and toks[after]["text"].lower() == "per" and toks[after + 1]["pos"] == "NOUN":
        end = after + 1
    return toks[k]["start"], toks[end]["end"]


def modifiers(toks: list[dict], name: bool = False) -> dict[int, list[int]]:
    """Noun -> the words left of it that hang on it in the tree: adjectives and nouns, for a ``name`` proper nouns too.

    Only words beside another of them or the noun count; a word that hangs on a modifier belongs to the noun as well.
    """
    kinds, found = ("ADJ", "NOUN", "PROPN") if name else ("ADJ", "NOUN"), {}
    for k, t in enumerate(toks):
        if t["pos"] not in ("NOUN", "PROPN"):
            continue
        low = k
        while low > 0 and toks[low - 1]["pos"] in kinds and low <= toks[low - 1]["head"] <= k:
            low -= 1
        if low < k:
            found[k] = list(range(low, k))
    return found


def tagged_numbers(text: str, ordinals: frozenset[str] = frozenset(), toks: list[dict] | None = None) -> list[tuple[int, int]]:
    """Numbers by their tags: spans of runs of number words with their signs; words of ``ordinals`` may be among them."""
    toks = tokens(text) if toks is None else toks
    return [(toks[a]["start"], toks[b - 1]["end"]) for a, b in number_tokens(toks, ordinals) if a < b]


@F.pandas_udf(SPAN)
def tagged_number_spans(texts: pd.Series) -> pd.Series:
    known = frozenset(w for w in vocab.ordinals() if " " not in w)
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in tagged_numbers(t or "", known)])


def _covered(t: dict, spans: list[tuple[int, int]]) -> bool:
    return any(a < t["end"] and t["start"] < b for a, b in spans)


def expanded(text: str, span: tuple[int, int], tag: str, taken: list[tuple[int, int]], toks: list[dict] | None = None, units: frozenset[str] | set[str] = frozenset()) -> tuple[int, int] | None:
    """A phrase hit with the modifiers of its first word, an entity also with the proper nouns and number after it.

    It neither grows into what is ``taken`` nor into a frequent unit, a property not into ``fourth-highest``. Where it
    overlaps what is taken it is clipped to the longer free side; inside it, it is dropped, but a property may lie in a unit.
    """
    toks = tokens(text) if toks is None else toks
    inner = [k for k, t in enumerate(toks) if t["start"] < span[1] and span[0] < t["end"]]
    if not inner:
        return None
    low, high = inner[0], inner[-1]
    for k in reversed(modifiers(toks, tag == "entity").get(low, [])):
        ordinal = tag == "property" and k > 1 and toks[k - 1]["text"] == "-"
        if ordinal or toks[k]["lemma"] in units or _covered(toks[k], taken):
            break
        low = k
    if tag == "entity":
        while high + 1 < len(toks) and toks[high + 1]["pos"] == "PROPN" and not _covered(toks[high + 1], taken):
            high += 1
        if text[toks[high]["end"] :].startswith(" CDP"):
            high += 1
    start, end = toks[low]["start"], toks[high]["end"]
    for a, b in taken:
        if a < end and start < b:
            if a <= start and end <= b:
                return None
            start, end = (start, a) if a - start >= end - b else (b, end)
            start += len(text[start:end]) - len(text[start:end].lstrip())
            end -= len(text[start:end]) - len(text[start:end].rstrip())
    return (start, end) if start < end else None


def expanded_all(text: str, spans: list[tuple[int, int]], tag: str, taken: list[tuple[int, int]], toks: list[dict], units: frozenset[str]) -> list[tuple[int, int]]:
    """All hits of a tag, expanded; those that then touch are one."""
    return merged([s for h in spans if (s := expanded(text, h, tag, taken, toks, units))])
