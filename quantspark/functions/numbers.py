"""Finding and parsing numbers in text.

The finder and the parser are Python kernels behind Arrow-batched UDFs; ``parse_plain`` is the SQL fast path for plain
integers and decimals, and ``parse_number`` sends only what it can't parse to the kernel.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions import vocab

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: For character classes: all dashes that can stand for a minus sign (fixed values).
DASHES = r"\-−‐‑‒–—―"
_SUPER = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_VULGAR = "¼½¾⅐⅑⅒⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"
_DIGITS = rf"(?:\d{{1,3}}(?:[,.' ’]\d{{3}})+(?!\d)|\d+)(?:[.,]\d+)?"
_POWER = rf"(?:[eE][+{DASHES}]?\d+(?![\w])|\s?[x×*⋅·]\s?\d+(?:\^[+{DASHES}]?\d+|[⁺⁻]?[{_SUPER}]+)?|\s10(?:\^[+{DASHES}]?\d+|[⁺⁻]?[{_SUPER}]+)|\^[+{DASHES}]?\d+|[⁺⁻]?[{_SUPER}]+)"
_FRACTION = rf"(?:\s?[+{DASHES}]?\s?\d+\s?)?[/⁄]\d+|\s?[{_VULGAR}]"
#: Digits start after a character that is neither a letter, digit nor inside another number.
_DIGIT_NUMBER = re.compile(rf"(?<![\w.,^/⁄])(?:(?<![^\s(])[+±√{DASHES}]\s?)?(?:[{_VULGAR}]|(?:{_DIGITS})(?:{_POWER})?(?:{_FRACTION})?)(?!(?:st|nd|rd|th)\b)")
_WORD = "|".join(sorted((w for w in {*vocab.cardinals(), *vocab.magnitudes()} | {vocab.plural(m) for m in vocab.magnitudes()}), key=lambda w: (-len(w), w)))
_WORDS = re.compile(rf"(?<![\w-])(?:{_WORD})(?:(?:[ -]|(?:(?<=hundred)|(?<=thousand)|(?<=illion)) and )(?:{_WORD}))*(?: and (?:a|one) (?:half|quarter|third))?(?![\w])", re.IGNORECASE)
_WORD_SET = frozenset(_WORD.split("|"))
_ANY_DIGIT = re.compile(rf"[\d{_VULGAR}]")
_MAGNITUDE = re.compile(rf" (?:{'|'.join(sorted(vocab.magnitudes(), key=len, reverse=True))})s?\b", re.IGNORECASE)

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_DATES = [
    re.compile(rf"\b(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:, ?\d{{4}})?\b"),
    re.compile(rf"\b\d{{1,2}}(?:st|nd|rd|th)? (?:of )?(?:{MONTHS})\.?(?:,? \d{{4}})?\b"),
    re.compile(rf"\b(?:{MONTHS})\.?,? (?:of )?\d{{4}}\b"),
    re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"),
    re.compile(r"(?:\b(?:in|since|until|till|by|from|before|after|during|of|to|and|between|circa|year|around|as of|early|late|mid)|\(|–|-)\s?(?:the )?(?P<year>(?:1[0-9]|20)\d{2})s?(?=[\s).,;:–-]|$)(?!,\d)(?!\s?(?:m|km|ft|kg|mi|feet|metres|meters|people|miles|tonnes|sq)\b)", re.IGNORECASE),
]
_DURATION = re.compile(r"\b(?:seconds|minutes|hours|days|weeks|months|years|decades|centuries)\b|^(?:a|an|one|1) (?:second|minute|hour|day|week|month|year|decade|century)$", re.IGNORECASE)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching and overlapping spans as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def find_dates(text: str) -> list[tuple[int, int]]:
    """Spans of calendar dates and of years in a position where a year stands; durations don't count."""
    found = []
    for pattern in _DATES:
        for m in pattern.finditer(text):
            span = m.span("year") if "year" in pattern.groupindex else m.span()
            if not _DURATION.search(text[span[0] : span[1]]):
                found.append(span)
    return merged(found)


def find_numbers(text: str | None, consider_ordinals: bool = False) -> list[tuple[int, int]]:
    """Spans of numbers in digits or words, without dates, ordinals and rates after ``per``."""
    if not text:
        return []
    # Most texts hold neither digits nor number words; both tests are far cheaper than the patterns.
    spans = [m.span() for m in _DIGIT_NUMBER.finditer(text)] if _ANY_DIGIT.search(text) else []
    if not _WORD_SET.isdisjoint(re.findall("[a-z]{3,}", text.lower())):
        spans += [m.span() for m in _WORDS.finditer(text)]
    if consider_ordinals:
        spans += [m.span() for m in re.finditer(r"(?<![\w.,])\d+(?:st|nd|rd|th)\b", text)]
    longer = []
    for start, end in spans:
        m = _MAGNITUDE.match(text, end)
        longer.append((start, m.end() if m else end))
    if not spans:
        return []
    dates = find_dates(text)
    kept = []
    for start, end in merged(longer):
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1] in " .,":
            end -= 1
        if start == end or text[:start].endswith(" per ") or any(a < end and start < b for a, b in dates):
            continue
        kept.append((start, end))
    return kept


def normalised_digits(text: str) -> str:
    """NFKC character by character, with a space between a normalised run and its neighbours (``10²`` -> ``10 2``)."""
    out, was = [], None
    for c in text:
        n = unicodedata.normalize("NFKC", c)
        now = n != c
        if was is not None and now != was and out and not out[-1].isspace() and not n.isspace():
            out.append(" ")
        out.append(n)
        was = now
    return "".join(out)


def _plain(text: str) -> float | int | None:
    t = text.replace(",", "").strip()
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    return float(t) if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?", t) else None


def _fraction_sum(text: str) -> float | None:
    t = re.sub(r"\s*([+-])\s*", r" \1", text.replace("//", "/").strip())
    t = re.sub(r"(?<=\d) (?=\d+/)", " +", t)
    parts = t.split()
    if not any("/" in p for p in parts):
        return None
    try:
        return float(sum(Fraction(p.replace(",", "")) for p in parts))
    except (ValueError, ZeroDivisionError):
        return None


class _Arithmetic:
    """Numbers with + - * / and powers; nothing else is evaluated."""

    _TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(\*\*|[-+*/()]))")

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = self._TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append(float(m[1]) if m[1] and not m[1].isdigit() else int(m[1]) if m[1] else m[2])
            at = m.end()
        self.at = 0

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self):
        found = self._sum()
        if self._peek() is not None:
            raise ValueError("left over")
        return found

    def _sum(self):
        left = self._product()
        while self._peek() in ("+", "-"):
            left = left + self._product() if self._next() == "+" else left - self._product()
        return left

    def _product(self):
        left = self._unary()
        while self._peek() in ("*", "/"):
            left = left * self._unary() if self._next() == "*" else left / self._unary()
        return left

    def _unary(self):
        if self._peek() in ("-", "+"):
            return -self._unary() if self._next() == "-" else self._unary()
        return self._power()

    def _power(self):
        base = self._atom()
        if self._peek() == "**":
            self._next()
            exponent = self._unary()
            if abs(exponent) > 1000:
                raise ValueError("exponent")
            return base**exponent
        return base

    def _atom(self):
        t = self._next() if self._peek() is not None else ")"
        if t == "(":
            inner = self._sum()
            if self._peek() != ")":
                raise ValueError("bracket")
            self._next()
            return inner
        if isinstance(t, str):
            raise ValueError(t)
        return t


def _expression(text: str) -> float | int | None:
    t = re.sub(r"(?<=\d)\s*[x×⋅·]\s*(?=\d)", "*", text).replace("^", "**").replace(",", "")
    t = re.sub(r"(?<=\d)\s+10(?=\*\*|\s+[+-]?\d)", "*10", t)
    t = re.sub(r"(?<=\*10)\s+(?=[+-]?\d)", "**", t)
    try:
        return _Arithmetic(t).value()
    except (ValueError, ZeroDivisionError, OverflowError, IndexError):
        return None


def _words(text: str) -> float | int | None:
    """Digits and number words: tens and units add, hundreds and magnitudes multiply what stands before them."""
    token = r"[+-]?\d[\d,]*(?:\.\d+)?|[^\W\d_]+"
    if re.sub(token, "", text.lower()).strip(" -,\t\n"):
        return None
    tokens = re.findall(token, text.lower())
    total, group, seen = 0, None, False
    for k, token in enumerate(tokens):
        if token in ("and", "plus"):
            continue
        if token == "a":
            if tokens[k + 1 : k + 2] and tokens[k + 1] in vocab.denominators() and group is not None:
                continue
            value = 1
        elif token[0].isdigit() or token[0] in "+-":
            value = _plain(token)
        else:
            value = vocab.word_value(token)
        if value is None:
            return None
        seen = True
        if token in vocab.denominators() and k and tokens[k - 1] not in ("and", "a"):
            group = (1 if group is None else group) * value
        elif 0 < value < 1:
            group = (group or 0) + value
        elif value >= 1000 and not token[0].isdigit() and token[0] not in "+-":
            total, group = total + (1 if group is None else group) * value, None
        elif value == 100 and token.startswith("hundred"):
            group = (1 if group is None else group) * 100
        else:
            group = value if group is None else group + value
    return total + (group or 0) if seen else None


def parse(text: str | None, words: bool = True) -> float | int | None:
    """The number that a text states, or None; never an error.

    In turn: integer, decimal, one number word, sum of fractions, digits with words, arithmetic expression.
    """
    if text is None:
        return None
    t = re.sub(f"[{DASHES}]", "-", text.strip()).replace("⁄", "/").replace("⁻", "-")
    t = re.sub(r"(?<=\d)(?:st|nd|rd|th)\b", "", normalised_digits(t).replace("⁄", "/"))
    if not t:
        return None
    steps = [_plain, lambda s: vocab.word_value(s) if words else None, _fraction_sum, _expression, lambda s: _words(s) if words else None]
    for step in steps:
        found = step(t)
        if found is not None:
            return found if abs(found) < float("inf") else None
    return None


def as_double(value: float | int | None) -> float | None:
    try:
        return None if value is None else float(value)
    except OverflowError:
        return None


@F.pandas_udf(T.DoubleType())
def _parse_udf(texts: pd.Series) -> pd.Series:
    known = {t: as_double(parse(t)) for t in texts.dropna().unique()}
    return texts.map(known).astype("float64")


def parse_plain(text: Column) -> Column:
    """Plain integers and decimals with grouping commas, in SQL; null for all else."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), bare.try_cast("double"))


def parse_number(text: Column) -> Column:
    """The value of a number in any notation, else null; only what isn't plain goes through Python."""
    rest = F.when(parse_plain(text).isNull(), text)
    return F.coalesce(parse_plain(text), F.when(rest.isNotNull(), _parse_udf(rest)))


@F.pandas_udf(T.StringType())
def nfkc_digits(texts: pd.Series) -> pd.Series:
    """``normalised_digits`` of each text."""
    return texts.map(lambda t: None if t is None else normalised_digits(t))


@F.pandas_udf(SPAN)
def number_spans(texts: pd.Series) -> pd.Series:
    """Spans of numbers (character offsets from 0) of each text."""
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in find_numbers(t)])


@F.pandas_udf(SPAN)
def date_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in find_dates(t or "")])


def digit_runs(text: Column) -> Column:
    """The ASCII digit runs of a text, in SQL."""
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
