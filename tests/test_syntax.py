"""The tagger and the trees against brute force, and what is read off them."""

import itertools
import random

import numpy as np
import pytest

from quantspark.operators import annotate, filters, paths, syntax

SF = "/root/testdata/sf0.01"


def small_tagger(seed: int) -> syntax.Tagger:
    r = random.Random(seed)
    tags = syntax.TAGS[:4]
    after = {(a, b): r.randrange(1, 60) for a in ["", *tags] for b in tags}
    words = {(t, w): r.randrange(0, 40) for t in tags for w in "abcd"}
    return syntax.tagger(after, words)


@pytest.mark.parametrize("seed", range(15))
def test_viterbi_against_all_sequences(seed):
    model, r = small_tagger(seed), random.Random(seed)
    words = [r.choice("abcdx") for _ in range(r.randint(1, 4))]

    def total(path):
        score = model.after[-1, path[0]] + model.emission(words[0], True)[path[0]]
        return score + sum(model.after[a, b] + model.emission(w, False)[b] for a, b, w in zip(path, path[1:], words[1:], strict=False))

    best = max(total(p) for p in itertools.product(range(len(syntax.TAGS)), repeat=len(words)))
    assert total([syntax.TAGS.index(t) for t in model.tags(words)]) == pytest.approx(best)


def is_tree(heads: tuple[int, ...]) -> bool:
    roots = [k for k, h in enumerate(heads) if h == k]
    if len(roots) != 1:
        return False
    for k in range(len(heads)):
        seen = set()
        while heads[k] != k:
            if k in seen:
                return False
            seen.add(k)
            k = heads[k]
    arcs = [(min(k, h), max(k, h)) for k, h in enumerate(heads) if h != k]
    crossing = any(a < c < b < d for a, b in arcs for c, d in arcs)
    return not crossing and not any(a < roots[0] < b for a, b in arcs)


def value(heads, score, root) -> float:
    return sum(root[k] if h == k else score[h, k] for k, h in enumerate(heads))


@pytest.mark.parametrize("seed", range(25))
def test_trees_against_all_projective_trees(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 6))
    score, root = r.normal(size=(n, n)) * 3, r.normal(size=n) * 3
    heads = syntax.projective_tree(score, root)
    assert is_tree(tuple(heads))
    best = max(value(h, score, root) for h in itertools.product(range(n), repeat=n) if is_tree(h))
    assert value(heads, score, root) == pytest.approx(best)


def test_long_sentences_have_one_tree():
    r = random.Random(1)
    text = " ".join(r.choice(["the", "old", "tower", "of", "Rome", "is", "5", "metres", ",", "and", "stands"]) for _ in range(160))
    heads = [t["head"] for t in annotate.tokens(text)]
    assert is_tree(tuple(heads)) and annotate.tokens("") == [] and [t["head"] for t in annotate.tokens("Go")] == [0]


def heads(text: str, tagger=None) -> dict[str, str]:
    toks = annotate.tokens(text, tagger)
    return {t["text"]: toks[t["head"]]["text"] for t in toks}


def test_heads_of_phrases():
    h = heads("The old stone bridge of Iron Q Tower is long.")
    assert h["old"] in ("bridge", "stone") and h["stone"] == "bridge" and h["bridge"] == "is" == h["is"] and h["Tower"] == "of" and h["Iron"] in ("Q", "Tower") and h["Q"] == "Tower"
    h = heads("The town has 17 wheels per mile.")
    assert h["17"] == "wheels" and h["wheels"] == "has" and h["mile"] == "per"


def test_tagger_uses_the_context(spark):
    docs = spark.createDataFrame([("The tower measures 5 metres. It weighs 7 tons. The measures are old. She weighs the gold. The town covers 3 acres of land.",), (None,), ("",)] * 30, "text string")
    model = syntax.fit(docs)
    assert model.after.shape == (len(syntax.TAGS) + 1, len(syntax.TAGS)) and np.allclose(np.exp(model.after).sum(1), 1)
    assert model.tags("The town covers 7 acres".split()) == ["DET", "NOUN", "VERB", "NUM", "NOUN"]
    # A word that isn't known goes by its form and its neighbours.
    assert model.tags("The glorb covers 7 acres".split())[1] == "NOUN"
    assert syntax.fit(docs, most=1).tags(["The", "town"])[0] == "DET" and model.tags([]) == []
    assert [t["pos"] for t in annotate.tokens("The town covers land", model)][2] == "VERB"


def test_tagger_of_a_whole_table(spark):
    model = syntax.fit(spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'"))
    assert 0 < len(model.word) <= syntax.MAX_WORDS + 200
    tags = model.tags("The house of the king is old".split())
    assert tags[0] == "DET" and tags[2] == "ADP" and tags[5] == "AUX"


@pytest.mark.parametrize("text,found", [
    ("It is - 5 m", ["- 5"]), ("about 5 / 8 in all", ["5 / 8"]), ("5 / of it", ["5"]), ("x 10 ^ 3 kg", ["10 ^ 3"]), ("3 + of them", ["3"]), ("one third of it", ["one third"]), ("the third of it", []), ("it has 1'000 parts", ["1'000"]), ("no numbers here", []), ("5 and 6 km", ["5", "6"]),
])
def test_numbers_by_tags(text, found):
    assert [text[a:b] for a, b in annotate.tagged_numbers(text, frozenset({"third"}))] == found


def test_number_spans_by_tags(spark):
    df = spark.createDataFrame([("There are 5 / 8 of one third.",), (None,)], "t string").withColumn("s", annotate.tagged_number_spans("t"))
    rows = [[substring_of(r.t, s) for s in r.s] for r in df.collect()]
    assert rows == [["5 / 8", "one third"], []]


def substring_of(text, s):
    return text[s.start : s.end]


def test_counted_noun_with_a_verb():
    text = "In all 5 people killed per year"
    assert text[slice(*annotate.count_noun(text, (7, 8), set()))] == "people killed per year"
    assert annotate.count_noun("5 is per year", (0, 1), set()) is None


def test_path_decides_between_names(spark):
    text = "The height of the tower with the old tower is 5 metres"
    toks = annotate.tokens(text)
    tree = [t["head"] for t in toks]
    near = paths.nearest(tree, [[4], [8]], [11])
    assert near == [0]
    names = [(18, 23), (37, 42)]
    df = spark.createDataFrame([(text, [dict(start=a, end=b) for a, b in names], [dict(start=46, end=54)])], "t string, s array<struct<start:int,end:int>>, m array<struct<start:int,end:int>>")
    row = df.select(filters.reduced("t", "s", "m").alias("r")).first().r
    assert row.reason == "choose_single_annotation_based_on_shortest_path" and [text[s.start : s.end] for s in row.spans] == ["tower"] and row.spans[0].start == 18


def test_trees_of_one_shape_are_found_once(monkeypatch):
    """Other words of the same tags and signs have the same heads; a sign elsewhere makes another tree."""
    from quantspark.operators import syntax

    runs, whole = [], syntax.projective_tree
    monkeypatch.setattr(syntax, "projective_tree", lambda *a: runs.append(1) or whole(*a))
    syntax._heads.cache_clear()
    tags = ["DET", "ADJ", "NOUN", "AUX", "PUNCT", "ADJ"]
    for words in (["the", "old", "bridge", "is", ",", "long"], ["a", "new", "tower", "was", ";", "tall"], ["a", "new", "tower", "was", "!", "tall"]):
        assert syntax.heads_of(words, tags) == whole(*syntax.arc_scores(words, tags))
    assert len(runs) == 2
