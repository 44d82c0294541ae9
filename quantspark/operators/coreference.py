"""Coreference of a sentence with the one before it: clusters of mentions, two ways to find them, one to read them.

A back-end is a function from (previous, sentence) to clusters; a cluster lists its mentions as spans of the two texts
laid end to end with a blank between them, the most specific one first. ``BACK_ENDS`` names those that come with the
engine; a trained model can be added under another name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quantspark.operators.annotate import tokens

Cluster = list[tuple[int, int]]
_PRONOUNS = frozenset("it its he his him she her they their them this".split())
_DEFINITE = frozenset("the this that these those".split())


def _subject(text: str) -> tuple[int, int] | None:
    """The first noun phrase of a sentence: everything before its first verb, without a comma."""
    toks = tokens(text)
    end = next((k for k, t in enumerate(toks) if t["pos"] in ("VERB", "AUX") or t["text"] in ",;:"), None)
    if not end or not any(t["pos"] in ("NOUN", "PROPN") for t in toks[:end]):
        return None
    return toks[0]["start"], toks[end - 1]["end"]


class _Groups:
    """Mentions that stand for the same thing (union-find)."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[max(self.root(a), self.root(b))] = min(self.root(a), self.root(b))

    def listed(self) -> list[list[int]]:
        by_root: dict[int, list[int]] = {}
        for k in range(len(self.up)):
            by_root.setdefault(self.root(k), []).append(k)
        return [g for g in by_root.values() if len(g) > 1]


@dataclass(frozen=True)
class Mention:
    """A phrase of the two texts laid end to end: its span, lemmas of its nouns, the last of these, and what it is."""

    span: tuple[int, int]
    nouns: tuple[str, ...]
    head: str
    kind: str  # name, definite, other, pronoun
    second: bool


def mentions(text: str, shift: int = 0, second: bool = False) -> list[Mention]:
    """Noun phrases (what hangs on a noun right before it, and the noun) and pronouns of a sentence, in order."""
    toks, found, k = tokens(text), [], 0
    while k < len(toks):
        if toks[k]["text"].lower() in _PRONOUNS and not (k + 1 < len(toks) and toks[k + 1]["pos"] in ("NOUN", "PROPN", "ADJ", "NUM")):
            found.append(Mention((toks[k]["start"] + shift, toks[k]["end"] + shift), (), toks[k]["lemma"], "pronoun", second))
            k += 1
            continue
        end = k
        while end < len(toks) and (toks[end]["pos"] in ("NOUN", "PROPN", "ADJ", "NUM") or (end == k and toks[end]["pos"] == "DET")):
            end += 1
        while end > k and toks[end - 1]["pos"] not in ("NOUN", "PROPN"):
            end -= 1
        if end > k:
            inner = toks[k:end]
            nouns = tuple(t["lemma"] for t in inner if t["pos"] in ("NOUN", "PROPN"))
            kind = "definite" if inner[0]["text"].lower() in _DEFINITE else "name" if any(t["pos"] == "PROPN" for t in inner) else "other"
            found.append(Mention((inner[0]["start"] + shift, inner[-1]["end"] + shift), nouns, nouns[-1], kind, second))
        k = max(end, k + 1)
    return found


def clusters(previous: str, sentence: str, pronouns_alone: bool = False) -> list[Cluster]:
    """Mentions of two sentences that stand for the same thing, the most specific one of each cluster first.

    A definite phrase joins the last phrase before it that holds its noun, a name the last name that it is part of, and
    pronouns the subject of the sentence before, if the sentence begins with one. Clusters that share a mention are one.
    """
    shift = len(previous) + 1
    subject = _subject(previous)
    all_ = [*mentions(previous), *mentions(sentence, shift, True)]
    if subject is not None:
        # The subject as a whole takes the place of the phrases within it.
        inner = [m for m in all_ if subject[0] <= m.span[0] and m.span[1] <= subject[1]]
        whole = Mention(subject, tuple(n for m in inner for n in m.nouns), inner[-1].head if inner else "", "name" if any(m.kind == "name" for m in inner) else "other", False)
        all_ = sorted([whole, *[m for m in all_ if m not in inner]], key=lambda m: m.span)
    groups = _Groups(len(all_))
    first = next((m for m in all_ if m.second), None)
    begins = bool(first and first.kind == "pronoun" and first.span[0] == shift)
    for k, m in enumerate(all_):
        earlier = [j for j in range(k) if all_[j].kind != "pronoun" and not (m.second and all_[j].second and m.kind == "other")]
        if m.kind == "pronoun":
            at = [j for j in range(k) if all_[j].span == subject]
            if m.second and begins and at:
                groups.join(k, at[0])
        elif not pronouns_alone and m.kind in ("definite", "name"):
            fits = (lambda o: m.head in o.nouns) if m.kind == "definite" else (lambda o: o.kind == "name" and set(m.nouns) <= set(o.nouns))
            at = [j for j in earlier if fits(all_[j])]
            if at:
                groups.join(k, at[-1])
    out = []
    for group in groups.listed():
        best = min(group, key=lambda k: (all_[k].second, ("name", "other", "definite", "pronoun").index(all_[k].kind), -(all_[k].span[1] - all_[k].span[0]), k))
        out.append([all_[k].span for k in [best, *[k for k in group if k != best]]])
    return sorted(out, key=lambda c: min(a for a, _ in c))


def by_pronoun(previous: str, sentence: str) -> list[Cluster]:
    """Pronouns of a sentence that begins with one stand for the subject of the sentence before."""
    return clusters(previous, sentence, pronouns_alone=True)


def nothing(previous: str, sentence: str) -> list[Cluster]:
    return []


BACK_ENDS: dict[str, Callable[[str, str], list[Cluster]]] = {"head_noun": clusters, "pronoun": by_pronoun, "single_words": clusters, "none": nothing}
#: Back-ends of which the head's words are looked at one by one, and whose mentions are single words.
SINGLE_WORDS = frozenset({"single_words"})


def _named(text: str, names: list[str]) -> bool:
    """Whether a text holds one of the names as whole words, by lemma."""
    have = [t["lemma"] for t in tokens(text)]
    for name in names:
        want = [t["lemma"] for t in tokens(name)]
        if want and any(have[k : k + len(want)] == want for k in range(len(have) - len(want) + 1)):
            return True
    return False


def resolved(previous: str | None, sentence: str, wanted: dict[str, list[str]], back_end: str = "head_noun") -> dict[str, tuple[int, int]]:
    """For each tag of ``wanted`` (tag to names) the first mention in ``sentence`` whose cluster's head names it.

    A head is cut before ``, which``, as what follows tells of something else. The search ends once all tags have one.
    """
    found: dict[str, tuple[int, int]] = {}
    if not previous:
        return found
    whole, shift = f"{previous} {sentence}", len(previous) + 1
    for cluster in BACK_ENDS[back_end](previous, sentence):
        inside = sorted(m for m in cluster if m[0] >= shift)
        if not inside:
            continue
        head = whole[slice(*cluster[0])].split(", which", 1)[0]
        a, b = inside[0]
        if back_end in SINGLE_WORDS:
            words, b = [t["text"] for t in tokens(head)], a + tokens(whole[a:b])[0]["end"]
        else:
            words = [head]
        for tag, names in wanted.items():
            if tag not in found and names and any(_named(w, names) for w in words):
                found[tag] = (a - shift, b - shift)
        if len(found) == len(wanted):
            break
    return found


def stand_in(previous: str | None, sentence: str, names: list[str], back_end: str = "head_noun") -> tuple[int, int] | None:
    """The first mention in ``sentence`` of what is called one of ``names``; None where there is none."""
    return resolved(previous, sentence, {"entity": names}, back_end).get("entity") if names else None
