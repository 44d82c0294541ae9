"""The phrase automaton against plain search, its split form, and stated values."""

import random

import pytest
from pyspark.sql import functions as F

from quantspark.functions.formats import representations
from quantspark.operators import frequency, phrases


def brute(words: list[str], listed: list[str]) -> list[tuple[str, int, int]]:
    parts = [p.split(" ") for p in listed]
    return sorted((" ".join(p), i, i + len(p) - 1) for p in parts for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)


def cases(seed: int) -> tuple[list[list[str]], list[str]]:
    r = random.Random(seed)
    listed = sorted({" ".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(25)})
    return [[r.choice("abcx") for _ in range(r.randint(0, 40))] for _ in range(60)], listed


@pytest.mark.parametrize("seed", range(20))
def test_automaton_finds_all(seed):
    texts, listed = cases(seed)
    automaton = phrases.Automaton(p.split(" ") for p in listed)
    for words in texts:
        found = automaton.found(automaton.number.get(w) for w in words)
        assert sorted((listed[k], a, b) for k, a, b in found) == brute(words, listed)


@pytest.mark.parametrize("shipped", [True, False])
def test_hits_in_tables(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(phrases, "MAX_SHIPPED", 3)
    texts, listed = cases(99)
    rows = spark.createDataFrame([(i, w, " ".join(w)) for i, w in enumerate(texts)] + [(-1, None, None)], "id long, words array<string>, text string")
    names = spark.createDataFrame([(p,) for p in [*listed, "", listed[0]]], "phrase string")
    want = sorted((i, *h) for i, w in enumerate(texts) for h in brute(w, listed))
    assert sorted(tuple(r) for r in phrases.word_hits(rows, ["id"], "words", names).collect()) == want
    assert sorted(tuple(r) for r in phrases.text_hits(rows, ["id"], "text", names).collect()) == want


def test_no_phrases(spark):
    rows = spark.createDataFrame([(1, ["a"])], "id long, words array<string>")
    assert phrases.word_hits(rows, ["id"], "words", spark.createDataFrame([], "phrase string")).count() == 0


def test_text_words_are_lemmas(spark):
    rows = spark.createDataFrame([(1, "Cities' Éclairs: 3 feet-long"), (2, None)], "id long, text string")
    names = spark.createDataFrame([("city",), ("éclair 3",), ("foot long",), ("cities",)], "phrase string")
    assert sorted((r.phrase, r.first, r.last) for r in phrases.text_hits(rows, ["id"], "text", names).collect()) == [("city", 0, 0), ("foot long", 3, 4), ("éclair 3", 1, 2)]


def test_alias_forms(spark):
    token = "array<struct<start:int,end:int,text:string,lemma:string>>"
    rows = spark.createDataFrame([(1, [(0, 2, "In", "in"), (3, 9, "Metres", "metre"), (10, 13, "per", "per"), (14, 20, "second", "second")])], f"id long, tokens {token}")
    aliases = spark.createDataFrame([("u", "a", "metre"), ("u", "a", "metres per second"), ("u", "b", "Seconds"), ("u", "c", "")], "kind string, uri string, alias string")
    spans = lambda df: {r.uri: [tuple(s) for s in r.spans] for r in df.collect()}
    assert spans(frequency.alias_spans(rows, ["id"], aliases)) == {"a": [(3, 20)], "b": [(14, 20)]}
    assert spans(frequency.alias_spans(rows, ["id"], aliases, "lower")) == {"a": [(3, 20)]}


def test_plans_make_no_row_for_each_run(spark):
    rows = spark.createDataFrame([(1, "a b c")], "id long, text string")
    plan = phrases.text_hits(rows, ["id"], "text", spark.createDataFrame([("a b",)], "phrase string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan


def test_stated_values(spark):
    s = "About two hundred people, 1,500 m, 1.5 thousand, 1500x and 21,500."
    find = lambda *values: [s[a:b] for a, b, _ in phrases.stated_spans([s], [list(values)], representations)[0]]
    assert find(1500.0) == ["1,500", "1.5 thousand"]
    assert find(200.0) == ["two hundred"]
    assert find(200.0, 1500.0) == ["two hundred", "1,500", "1.5 thousand"]
    assert find() == [] and phrases.stated_spans([None, s], [[5.0], None], representations) == [[], []]
    df = spark.createDataFrame([(s, [200.0]), (None, [1.0]), (s, None)], "t string, v array<double>")
    assert [[tuple(x) for x in r.f] for r in df.select(phrases.stated_values("t", "v").alias("f")).collect()] == [[(6, 17, 200.0)], [], []]


def test_stated_values_in_slices(monkeypatch):
    texts, values = [f"it is {k} or {k + 1}" for k in range(40)], [[float(k + 1)] for k in range(40)]
    whole = phrases.stated_spans(texts, values, representations)
    monkeypatch.setattr(phrases, "MAX_STATED", 1)
    assert phrases.stated_spans(texts, values, representations) == whole
    assert all(any(t[a:b] == str(k + 1) for a, b, _ in f) for k, (t, f) in enumerate(zip(texts, whole, strict=True)))


def test_shipped_names_are_lower_case(spark):
    df = spark.createDataFrame([(1, "The Of")], "id long, text string")
    units = spark.createDataFrame([("U",), ("V",)], "qid string")
    labels = spark.createDataFrame([("units", "U", "the of"), ("units", "V", "nothing")], "kind string, uri string, alias string")
    stop = spark.createDataFrame([("the",)], "word string")
    found = frequency.unit_frequencies(df, ["id"], units, labels, stop).orderBy("qid")
    assert [tuple(r) for r in found.select("qid", F.col("n").cast("int")).collect()] == [("U", 1), ("V", 0)]


def test_stated_strings_that_no_text_holds_are_left_out(monkeypatch):
    """The automaton holds what texts contain; a value stated in another text alone is none of this one's."""
    from quantspark.operators import phrases

    sizes, whole = [], phrases.Automaton
    monkeypatch.setattr(phrases, "Automaton", lambda p: sizes.append(len(p)) or whole(p))
    found = phrases.stated_spans(["It has 1,200 or 12 wheels.", "Twelve of 1200.", None, "12a 112"], [[1200.0], [12.0, 1200.0, None], [5.0], [12.0]], lambda v: ["1,200", "1200", "1 200"] if v == 1200 else ["12", "Twelve", "5"])
    assert found == [[(7, 12, 1200.0)], [(0, 6, 12.0), (10, 14, 1200.0)], [], []] and sum(sizes) <= 5
