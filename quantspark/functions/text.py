"""Text normalisation and markup cleaning: SQL expressions where Java's regular expressions do, Arrow UDFs for Unicode forms and nesting."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.functions.numbers import SPAN

INFOBOXES = ("infobox", "sidebar", "taxobox", "automatic taxobox", "speciesbox", "chembox", "drugbox", "geobox", "navbox")
ABBREVIATIONS = "e.g i.e etc vs approx ca cf no vol fig st dr mr mrs ms prof jr sr inc ltd co sq ft est dept gen rev capt lt u.s u.k".split()


@F.pandas_udf(T.StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def unquoted(url: Column) -> Column:
    """A percent-encoded text decoded; unlike in forms, ``+`` is itself."""
    return F.try_url_decode(F.regexp_replace(url, r"\+", "%2B"))


def braces(text: str, opening: str = "{{", closing: str = "}}") -> list[tuple[int, int]]:
    """Spans of outermost balanced pairs; an opening without an end reaches to the next line break or the end."""
    spans, depth, start, at = [], 0, 0, 0
    while at < len(text):
        if text.startswith(opening, at):
            start = at if depth == 0 else start
            depth += 1
            at += len(opening)
        elif depth and text.startswith(closing, at):
            depth -= 1
            at += len(closing)
            if depth == 0:
                spans.append((start, at))
        else:
            at += 1
    if depth:
        end = text.find("\n", start)
        spans.append((start, len(text) if end < 0 else end))
    return spans


def template_name(template: str) -> str:
    return re.sub(r"\s+", " ", template.strip("{} \n").split("|", 1)[0]).strip().lower()


def clean_page(text: str) -> str:
    """A page's markup without comments, infoboxes and sidebars."""
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    for start, end in reversed(braces(text)):
        if template_name(text[start:end]).startswith(INFOBOXES):
            text = text[:start] + text[end:]
    return text


def clean_template(text: str) -> str:
    """A template's inner text without braces, references, comments, links and entities."""
    text = text.strip()
    text = re.sub(r"^\{\{|\}{1,2}$", "", text)
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    text = re.sub(r"<ref[^>/]*/>|<ref.*?</ref>", "", text, flags=re.DOTALL | re.IGNORECASE)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    text = text.replace("&nbsp;", " ").replace("&ndash;", "–").replace("&minus;", "−").replace("&times;", "×").replace("&amp;", "&")
    return re.sub(r"<[^>]+>", "", text).strip()


def plain_text(markup: str) -> list[str]:
    """Paragraphs of a page's markup: no templates, tables, references, files, links or emphasis; headings stay as ``##``."""
    t = re.sub(r"<ref[^>/]*/>|<ref.*?</ref>|<!--.*?-->", "", markup, flags=re.DOTALL | re.IGNORECASE)
    t = re.sub(r"<(math|gallery|timeline|score|code|syntaxhighlight)\b.*?</\1>", "", t, flags=re.DOTALL | re.IGNORECASE)
    for opening, closing in (("{{", "}}"), ("{|", "|}")):
        for start, end in reversed(braces(t, opening, closing)):
            t = t[:start] + t[end:]
    for start, end in reversed(braces(t, "[[", "]]")):
        inner = t[start + 2 : end - 2]
        gone = re.match(r"(?i)\s*(file|image|category|media):", inner)
        t = t[:start] + ("" if gone else inner.rsplit("|", 1)[-1].replace("[[", "").replace("]]", "")) + t[end:]
    t = re.sub(r"\[https?://\S+\s*([^\]]*)\]", r"\1", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"<br\s*/?>", "\n", t)
    t = re.sub(r"<[^>]+>", "", t)
    t = t.replace("&nbsp;", " ").replace("&ndash;", "–").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    t = re.sub(r"^[*#:;]+\s*", "", t, flags=re.MULTILINE)
    t = re.sub(r"^(=+)[ \t]*(.*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.MULTILINE)
    t = re.sub(r"\(\s*[,;:]*\s*\)|__[A-Z]+__", "", t)
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r" +([,.;:])", r"\1", t)
    return [p.strip() for p in re.split(r"\n{2,}", t) if p.strip()]


def split_at_templates(page: str, names: tuple[str, ...] = ("convert", "cvt")) -> tuple[list[str], list[str]]:
    """A page as texts and the outermost templates of the given names between them (one more text than templates)."""
    texts, found, at = [], [], 0
    for start, end in braces(page):
        if template_name(page[start:end]) in names:
            texts.append(page[at:start])
            found.append(page[start:end])
            at = end
    return [*texts, page[at:]], found


_DELETE = re.compile(r"^[\s,]+|\s+$|\[\[|\]\]|\(\s*[,;]?\s*\)| (?=\s)|(?<=\() +| +(?=\))")


def postprocess_sentence(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The sentence without leftovers of markup, and its spans moved along.

    A deletion before a span moves it left; one that cuts into it clamps it to the deletion's start.
    """
    moved = [list(s) for s in spans]
    for m in reversed(list(_DELETE.finditer(text))):
        a, b = m.span()
        text = text[:a] + text[b:]
        for s in moved:
            for k in (0, 1):
                s[k] = s[k] - (b - a) if s[k] >= b else min(s[k], a)
    return text, [(a, b) for a, b in moved]


_SENTENCE_END = re.compile(r"[.!?][\"')\]]*(?:(?!\n\n)\s)+(?=[\"'(\[]?[A-ZÀ-Þ0-9])|\n\n")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; a paragraph break is a sentence of its own, abbreviations and initials don't end one."""
    spans, start = [], 0
    for m in _SENTENCE_END.finditer(text):
        if m[0] == "\n\n":
            if text[start : m.start()].strip():
                spans.append((start, m.start()))
            spans.append(m.span())
            start = m.end()
            continue
        word = text[start : m.start()].rsplit(None, 1)[-1] if text[start : m.start()].split() else ""
        if m[0][0] == "." and (word.lower().lstrip("(").rstrip(".") in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word)):
            continue
        end = m.start() + len(m[0].rstrip())
        spans.append((start, end))
        start = m.end()
    if text[start:].strip():
        spans.append((start, len(text.rstrip())))
    return spans


@F.pandas_udf(SPAN)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in split_sentences(t or "")])


@F.pandas_udf(T.StringType())
def cleaned_page(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else clean_page(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain_text(t))


POSTPROCESSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPAN)])


@F.pandas_udf(POSTPROCESSED)
def postprocessed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = [postprocess_sentence(t, [(s["start"], s["end"]) for s in ss]) for t, ss in zip(texts, spans, strict=True)]
    return pd.DataFrame({"text": [t for t, _ in out], "spans": [[{"start": a, "end": b} for a, b in ss] for _, ss in out]})


def enclosed(text: str, opening: str = "(", closing: str = ")") -> list[tuple[int, int]]:
    """Spans of all balanced brackets, inner ones too (positions of the brackets, end exclusive)."""
    stack, spans = [], []
    for at, c in enumerate(text):
        if c == opening:
            stack.append(at)
        elif c == closing and stack:
            spans.append((stack.pop(), at + 1))
    return sorted(spans)


@F.pandas_udf(SPAN)
def bracketed(texts: pd.Series) -> pd.Series:
    """The spans of all balanced brackets."""
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in enclosed(t or "")])


@F.pandas_udf(T.StringType())
def cleaned_template(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else clean_template(t))


def is_of_which(text: Column, start: Column) -> Column:
    """Whether the text before ``start`` ends in "of which", so that a share follows."""
    return F.substring(text, F.lit(1), start).rlike(r" of which,? $")


def plural(word: Column) -> Column:
    stem = F.regexp_replace(word, "y$", "")
    return F.when(word.endswith("s"), word).when(word.endswith("y"), F.concat(stem, F.lit("ies"))).when(word.endswith("x"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def full_text(texts: Column, quantities: Column) -> Column:
    """Runs of text with quantities between them as one text; a null quantity adds nothing."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.coalesce(t, F.lit("")), F.coalesce(F.get(quantities, i), F.lit("")))), "")


def shortened(text: Column) -> Column:
    """The first and last paragraph of a text run."""
    parts = F.split(text, "\n\n")
    return F.when(F.size(parts) <= 2, text).otherwise(F.concat_ws("\n\n", F.element_at(parts, 1), F.element_at(parts, -1)))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPAN)]))
def decoded_inline(texts: pd.Series, tags: pd.Series) -> pd.DataFrame:
    """Texts with spans marked by a tag on either side, as text and spans."""
    out = []
    for text, tag in zip(texts, tags, strict=True):
        plain, spans = "", []
        for k, part in enumerate(text.split(tag)):
            if k % 2:
                spans.append({"start": len(plain), "end": len(plain) + len(part)})
            plain += part
        out.append((plain, spans))
    return pd.DataFrame(out, columns=["text", "spans"])
