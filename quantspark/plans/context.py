"""Context dataset: sentences whose numbers state known facts, with entity, property, unit and qualifiers.

The job is a chain of joins on page and sentence; see ``operators.matching`` for the band join. Page text is read
once, for pages with facts only; each drop carries its reason.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.numbers import SPAN, date_spans, number_spans, parse_number
from quantspark.functions.spans import substring
from quantspark.functions.text import full_text, sentence_spans
from quantspark.operators import filters, matching
from quantspark.operators.annotate import components, count_noun, expanded_all
from quantspark.operators.coreference import stand_in
from quantspark.operators.frequency import alias_spans
from quantspark.operators.sequence import paragraphs, with_previous
from quantspark.operators.syntax import Tagger
from quantspark.session import ship
from quantspark.sources.tables import cut

SENTENCE = ["page_id", "sent_idx"]
EXAMPLE = [*SENTENCE, "fact_id", "unit"]
_SPANS = "array<struct<start:int,end:int>>"


def pages_of_interest(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages with quantities or facts, with ``has_quantities`` and ``has_facts``."""
    known = facts.select(F.col("page_id").alias("id")).distinct().withColumn("has_facts", F.lit(True))
    marked = pages.join(known, "id", "left").withColumns({"has_facts": F.coalesce("has_facts", F.lit(False)), "has_quantities": F.coalesce(F.size("quantities") > 0, F.lit(False))})
    return marked.where("has_quantities OR has_facts")


def sentences(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """page_id, title, sent_idx, par_idx, sentence, the one before it in its paragraph, and numbers' spans, of pages with facts.

    Short sentences state no facts and have no numbers here, but are context of others; ``enough`` tells the others.
    """
    some = pages.join(facts.select(F.col("page_id").alias("id")).distinct(), "id", "left_semi")
    runs = F.transform("text", lambda p: F.array_join(p, "\n\n"))
    sides = F.transform(F.coalesce("quantities", F.array().cast("array<array<string>>")), lambda q: F.get(q, F.lit(2)))
    text = some.select(F.col("id").alias("page_id"), "title", full_text(runs, sides).alias("text"))
    split = text.select("page_id", "title", "text", F.posexplode(sentence_spans("text")).alias("sent_idx", "s"))
    rows = split.select("page_id", "title", "sent_idx", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence"))
    blank = F.col("sentence").rlike(r"^\s*$")
    rows = paragraphs(rows, ["page_id"], ["sent_idx"], blank).where(~blank)
    rows = with_previous(rows, ["page_id", "par_idx"], ["sent_idx"], "sentence")
    rows = rows.withColumn("enough", F.size(F.split(F.trim("sentence"), r"\s+")) >= 3)
    return rows.withColumn("numbers", number_spans(F.when(F.col("enough"), F.col("sentence"))))


def contexts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, par_idx, paragraph): the sentences of paragraphs that ``wanted`` (page_id, par_idx) names, in order."""
    some = found.join(wanted.distinct(), ["page_id", "par_idx"], "left_semi")
    return some.groupBy("page_id", "par_idx").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("paragraph"))


def stated_numbers(found: DataFrame) -> DataFrame:
    """page_id, sent_idx, span, text, value of each number."""
    rows = found.select(*SENTENCE, "sentence", F.explode("numbers").alias("span"))
    rows = rows.select(*SENTENCE, "span", substring(F.col("sentence"), F.col("span")).alias("text"))
    return rows.withColumn("value", parse_number(F.col("text"))).where("value IS NOT NULL")


def alias_hits(candidates: DataFrame, hits: DataFrame, labels: DataFrame, uri: str, kind: str, name: str) -> DataFrame:
    """Candidates with the spans of the aliases of their ``uri`` as column ``name``, the aliases, and whether there are any."""
    aliases = labels.where(F.col("kind") == kind).groupBy(F.col("uri").alias(uri)).agg(F.array_sort(F.collect_set("alias")).alias(f"{name}_aliases"))
    own = hits.where(F.col("kind") == kind).select(*SENTENCE, F.col("uri").alias(uri), F.col("spans").alias(name))
    joined = candidates.join(own, [*SENTENCE, uri], "left").join(aliases, uri, "left")
    return joined.withColumns({name: F.coalesce(name, F.array().cast(_SPANS)), f"{name}_known": F.col(f"{name}_aliases").isNotNull()})


def _pairs(spans: object) -> list[tuple[int, int]]:
    return [] if spans is None else [(s["start"], s["end"]) for s in spans if s is not None]


def _structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def _stand_ins(back_end: str) -> Callable[..., F.Column]:
    @F.pandas_udf(SPAN)
    def run(previous: pd.Series, texts: pd.Series, names: pd.Series) -> pd.Series:
        found = [stand_in(p, t, [] if n is None else list(n), back_end) for p, t, n in zip(previous, texts, names, strict=True)]
        return pd.Series([_structs([f] if f else []) for f in found])

    return run


@F.pandas_udf(SPAN)
def _count_nouns(texts: pd.Series, values: pd.DataFrame, tokens: pd.Series, units: pd.Series) -> pd.Series:
    """The noun that a number counts, unless it is a frequent unit."""
    out = []
    for text, a, b, toks, known in zip(texts, values["start"], values["end"], tokens, units, strict=True):
        found = count_noun(text, (a, b), frozenset(known), list(toks))
        out.append(_structs([found] if found else []))
    return pd.Series(out)


def _expanded(tag: str) -> Callable[..., F.Column]:
    @F.pandas_udf(SPAN)
    def run(texts: pd.Series, spans: pd.Series, taken: pd.Series, tokens: pd.Series, units: pd.Series) -> pd.Series:
        rows = zip(texts, spans, taken, tokens, units, strict=True)
        return pd.Series([_structs(expanded_all(t, _pairs(s), tag, _pairs(o), list(k), frozenset(u))) for t, s, o, k, u in rows])

    return run


def qualifier_hits(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, sent_idx, fact_id, unit, tag, spans) of qualifiers that a sentence states: dates, aliases of values and units."""
    rows = candidates.select(*EXAMPLE, "sentence", F.explode("qualifiers").alias("q")).withColumn("tag", matching.qualifier_tag(F.col("q.qualifier"))).where("tag IS NOT NULL")
    timed = rows.where(F.col("tag").isin(*matching.TIME_QUALIFIERS.values()))
    dated = timed.withColumn("d", F.explode(date_spans("sentence")))
    dates = dated.select(*EXAMPLE, "tag", "d", F.col("q.value").alias("value"), F.col("q.time_precision").alias("time_precision"), substring(F.col("sentence"), F.col("d")).alias("date_text"))
    stated = dates.withColumns({"known": matching.parse_known(F.col("value")), "known_precision": F.coalesce(matching.precision_of(F.col("time_precision")), F.lit("day")), "stated": matching.parse_date(F.col("date_text"))})
    in_time = stated.where(matching.same_date(F.col("known"), F.col("known_precision"), F.col("stated.at"), F.col("stated.precision"))).groupBy(*EXAMPLE, "tag").agg(F.collect_set("d").alias("spans"))
    named = rows.where(~F.col("tag").isin(*matching.TIME_QUALIFIERS.values(), "coordinate_location"))
    uris = F.filter(F.array(F.struct(F.lit("qualifiers_values").alias("kind"), F.col("q.value").alias("uri")), F.struct(F.lit("qualifiers_units").alias("kind"), F.col("q.unit").alias("uri"))), lambda u: u["uri"].isNotNull())
    named = named.select(*EXAMPLE, "tag", F.inline(uris)).join(hits, [*SENTENCE, "kind", "uri"])
    named = named.groupBy(*EXAMPLE, "tag").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    placed = rows.where(F.col("tag") == "coordinate_location").withColumn("spans", matching.coordinate_spans("sentence", F.col("q.value")))
    placed = placed.where(F.size("spans") > 0).groupBy(*EXAMPLE, "tag").agg(F.first("spans").alias("spans"))
    return in_time.unionByName(named).unionByName(placed)


def examples(pages: DataFrame, facts: DataFrame, labels: DataFrame, conversions: DataFrame, frequent_units: DataFrame | None = None, back_end: str = "head_noun", tagger: Tagger | None = None) -> DataFrame:
    """All candidates with annotations and the reason for which each is dropped, if any.

    ``frequent_units`` (alias) are names of frequent units, next to which a value isn't the fact's and which no phrase
    grows into. ``back_end`` names the coreference, ``tagger`` is one that ``syntax.fit`` made. Aliases of all kinds are found by one automaton over lemmas, names of
    frequent units by one over words in lower case, in candidates' sentences alone, each of which is annotated once.
    """
    ship(pages.sparkSession)
    everything = cut(sentences(pages, facts))
    found = everything.where("enough")
    targets = matching.variants(facts, conversions, labels.where("kind = 'units'"))
    matches = matching.value_matches(stated_numbers(found), targets, ["page_id"])
    unique = matching.unique_values(matches.select(*EXAMPLE, "span", "text", "value", "deviation", "by_rounding", "is_count", "is_temperature", "inside"), EXAMPLE, ~F.col("m.is_count"))
    some = found.join(unique.select(*SENTENCE).distinct(), SENTENCE, "left_semi")
    some = cut(components(some, "sentence", ("tokens",), tagger))
    wanted = labels.where(F.col("kind").isin("entities", "properties", "units", "qualifiers_values", "qualifiers_units"))
    words = some.select(*SENTENCE, "tokens")
    hits = alias_spans(words, SENTENCE, wanted)
    if frequent_units is not None:
        named = frequent_units.select(F.lit("frequent").alias("kind"), F.lit("frequent").alias("uri"), "alias")
        hits = hits.unionByName(alias_spans(words, SENTENCE, named, "lower"))
    hits = cut(hits)
    cand = unique.join(some.select(*SENTENCE, "title", "par_idx", "sentence", "tokens", "numbers", "previous"), SENTENCE)
    cand = cand.join(facts.select("page_id", "fact_id", "entity", "property", F.col("value").alias("fact_value"), F.col("unit").alias("fact_unit"), "qualifiers"), ["page_id", "fact_id"])
    for uri, kind, name in (("entity", "entities", "entity_spans"), ("property", "properties", "property_spans"), ("unit", "units", "unit_spans")):
        cand = alias_hits(cand, hits, labels, uri, kind, name)
    frequent = hits.where("kind = 'frequent'").select(*SENTENCE, F.col("spans").alias("frequent"))
    cand = cand.join(frequent, SENTENCE, "left").withColumn("frequent", F.coalesce("frequent", F.array().cast(_SPANS)))
    near = F.filter("tokens", lambda t: F.exists("frequent", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    cand = cand.withColumn("frequent_lemmas", F.array_distinct(F.transform(near, lambda t: t["lemma"])))
    value = F.col("span")
    nouns = _count_nouns("sentence", "span", "tokens", "frequent_lemmas")
    cand = cut(cand.withColumn("unit_spans", F.when(F.col("is_count"), nouns).otherwise(F.col("unit_spans"))))
    cand = cand.withColumn("unit_span", matching.unit_choice(F.col("unit_spans"), value))
    taken = F.filter(F.array(value, F.col("unit_span")), lambda s: s.isNotNull())
    for tag in ("property", "entity"):
        # A property may lie inside a unit.
        beside = F.array(value) if tag == "property" else taken
        cand = cand.withColumn(f"{tag}_spans", _expanded(tag)("sentence", f"{tag}_spans", beside, "tokens", "frequent_lemmas"))
    cand = cut(cand)
    known = F.col("entity_spans_known") & F.col("property_spans_known")
    after = F.substring("sentence", F.col("span.end") + 1, 10)
    rare = filters.is_rare(F.col("text"), F.col("deviation"), F.col("is_count"), after)
    must = F.array(value, F.col("unit_span"))
    # An entity that only the sentence before names: for exact values of a named property that aren't counts.
    apart = ~F.col("is_count") & (F.col("deviation") == 0) & (F.size("property_spans") > 0) & (F.size("entity_spans") == 0)
    mention = _stand_ins(back_end)(F.col("previous"), F.col("sentence"), F.col("entity_spans_aliases"))
    cand = cand.withColumn("stand_in", mention).withColumn("by_coreference", apart & (F.size("stand_in") > 0))
    cand = cand.withColumn("entity_spans", F.when(F.col("by_coreference"), F.col("stand_in")).otherwise(F.col("entity_spans")))
    for name in ("property_spans", "entity_spans"):
        cand = cand.withColumn("__r", filters.reduced("sentence", name, must)).withColumns({name: F.col("__r.spans"), f"{name}_reason": F.col("__r.reason")}).drop("__r")
    no_unit = ~F.col("is_count") & F.col("unit_span").isNull()
    nothing = F.array().cast(_SPANS)
    cand = cut(cand)
    reason = F.coalesce(
        F.when(~known, "missing_alias_for_entity_or_property"), F.col("drop_reason"), filters.value_drop_reason(F.col("sentence"), value),
        F.when(no_unit & (F.size("unit_spans") > 1), "multiple_units_adjecent_to_value"), F.when(no_unit, "no_unit"),
        F.when(F.col("unit_span").isNotNull(), filters.unit_drop_reason(F.col("sentence"), F.col("unit_span"), value, F.col("numbers"), F.filter("frequent", lambda h: h["start"] != F.col("unit_span.start")))),
        filters.context_drop_reason(F.col("sentence"), F.col("entity_spans"), F.col("property_spans"), rare),
        F.when(filters.mixes_dimensions(F.col("sentence"), F.col("property"), value, F.col("property_spans")), "prevent_mixing_up_height_width_and_depth"),
    )
    cand = cut(cand.withColumn("drop_reason", reason))
    stated = qualifier_hits(cand.where("drop_reason IS NULL"), hits).groupBy(*EXAMPLE).agg(F.map_from_entries(F.collect_list(F.struct("tag", "spans"))).alias("found_qualifiers"))
    cand = cut(cand.join(stated, EXAMPLE, "left"))
    small = filters.small_count_without_qualifier(F.col("value"), F.col("is_count"), F.coalesce(F.size("found_qualifiers"), F.lit(0)))
    weak = F.filter(F.array(F.when(F.col("by_rounding"), "relax_threshold_for_small_rounded_values"), F.when((F.size("property_spans") == 0) & rare, "no_property_but_rare_num_exact_match"), F.col("property_spans_reason"), F.col("entity_spans_reason"), F.when(F.col("by_coreference"), "found_entity_with_coreference_resolution")), lambda r: r.isNotNull())
    main = F.create_map(F.lit("entity"), F.col("entity_spans"), F.lit("property"), F.col("property_spans"), F.lit("value"), F.array(value), F.lit("unit"), F.when(F.col("unit_span").isNull(), nothing).otherwise(F.array(F.col("unit_span"))))
    annotations = F.map_filter(F.map_concat(main, F.coalesce("found_qualifiers", F.create_map().cast(f"map<string,{_SPANS}>"))), lambda tag, spans: F.size(spans) > 0)
    fact = F.struct("fact_id", "entity", "property", F.col("fact_value").alias("value"), F.col("fact_unit").alias("unit"))
    # The paragraph of what is accepted comes last, one row for each paragraph.
    cand = cand.withColumn("__par", F.when(F.coalesce("drop_reason", small).isNull(), F.col("par_idx")))
    around = contexts(everything, cand.where("__par IS NOT NULL").select("page_id", "par_idx")).withColumnRenamed("par_idx", "__par")
    cand = cand.join(around, ["page_id", "__par"], "left")
    of = lambda kept: F.transform(F.filter("paragraph", kept), lambda s: s["sentence"])
    context = F.struct(of(lambda s: s["sent_idx"] < F.col("sent_idx")).alias("before"), of(lambda s: s["sent_idx"] > F.col("sent_idx")).alias("after"))
    return cand.select(*SENTENCE, "title", "fact_id", "unit", "sentence", annotations.alias("annotations"), fact.alias("fact"), context.alias("context"), weak.alias("weak_accept_reasons"), F.coalesce("drop_reason", small).alias("drop_reason"))


def dataset(pages: DataFrame, facts: DataFrame, labels: DataFrame, conversions: DataFrame, frequent_units: DataFrame | None = None, back_end: str = "head_noun") -> DataFrame:
    """The context dataset: accepted examples after reconciliation within each sentence."""
    return reconciled_dataset(examples(pages, facts, labels, conversions, frequent_units, back_end))


def reconciled_dataset(found: DataFrame) -> DataFrame:
    """What is accepted of ``examples``, after reconciliation within each sentence."""
    accepted = found.where("drop_reason IS NULL").drop("drop_reason")
    judged = filters.reconciled(accepted, SENTENCE, ["fact_id", "unit"]).where("reconcile_reason IS NULL")
    return judged.select(F.col("page_id").alias("id"), "title", "sent_idx", "sentence", "annotations", "fact", "context", "weak_accept_reasons")
