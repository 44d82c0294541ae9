"""Sources, sinks, jobs and the stream."""

import bz2
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from quantspark import cli, schemas
from quantspark.operators import frequency, graph_patterns, sequence, statements
from quantspark.plans import catalogue, catalogue_jobs, context, parse, quantity, unit_frequencies
from quantspark.sources import documents, dump, endpoint, tables
from quantspark.streaming import pages as page_stream

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">
<page><title>Tower</title><ns>0</ns><id>1</id><revision><id>99</id><text xml:space="preserve">The '''tower''' is {{convert|324|m|ft}} tall and made of iron.&lt;!-- c --&gt;</text></revision></page>
<page><title>Old</title><ns>0</ns><id>2</id><revision><id>98</id><text>#REDIRECT [[Tower]]</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>3</id><revision><id>97</id><text>talk</text></revision></page>
</mediawiki>"""


@pytest.fixture
def dump_path(tmp_path):
    path = tmp_path / "enwiki-20220818-pages.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    return str(path)


def test_dump(spark, dump_path):
    job = dump.DumpJob(dump_path)
    assert job.language == "en"
    rows = dump.articles(spark, job).collect()
    assert [(r.id, r.title) for r in rows] == [(1, "Tower")]
    page = parse.parse(spark, dump.DumpJob(dump_path, "convert")).first()
    assert page.quantities == [["324 metres", "1,063 ft", "324 metres (1,063 ft)"]] and page.text == [["The tower is "], [" tall and made of iron."]]
    assert parse.parse(spark, dump.DumpJob(dump_path, "raw", limit=1)).first().id == 1
    with pytest.raises(ValueError):
        dump.DumpJob(dump_path, "other")
    with pytest.raises(ValueError):
        dump.statistics("xx")


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", [["Ünï"]], [["1 m", "3 ft", "1 m (3 ft)"], None])], schemas.PAGES_PARSED)
    tables.write_json_lines(df, f"file://{tmp_path}/pages")
    again = tables.read_pages(spark, f"file://{tmp_path}/pages").first()
    assert again.text == [["Ünï"]] and again.quantities[0][1] == "3 ft"
    examples = spark.createDataFrame([(1, [1]), (2, []), (3, None)], "id int, found array<int>")
    tables.write_examples(examples, f"file://{tmp_path}/examples", ["found"])
    assert spark.read.json(f"file://{tmp_path}/examples").count() == 1


def test_knowledge_round_trip(spark, tmp_path):
    _, facts, labels, conversions = catalogue.mini_corpus(spark)
    tables.write_knowledge({"facts": facts, "labels": labels, "unit_conversions": conversions}, f"file://{tmp_path}/k")
    known = tables.read_knowledge(spark, f"file://{tmp_path}/k")
    assert known["facts"].count() == 2 and tuple(tables.knowledge_totals(known["facts"]).first()) == (2, 1)
    nested = {"labels": {"units": {"Q1": ["m", "metre"]}}, "quantitative_statements": {"7": [{"entity": "E", "property": "P", "value": "5", "unit": "Q1", "qualifiers": []}]}, "unit_conversion_data": {"Q1": [{"to_unit": "Q1", "conv_factor_numerator": "1", "conv_factor_denominator": "1"}]}}
    (tmp_path / "k.json").write_text(json.dumps(nested))
    found = tables.read_knowledge_json(spark, f"file://{tmp_path}/k.json")
    assert found["labels"].count() == 2 and found["facts"].first().page_id == 7 and found["unit_conversions"].first().num == "1"


def _entries(document: dict, levels: dict[str, int]) -> list:
    """What json_entries lists, by plain Python."""
    found = []

    def walk(value, keys, level):
        if len(keys) == level:
            found.append((tuple(keys), json.dumps(value)))
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, [*keys, k], level)

    for k, v in document.items():
        if k in levels:
            walk(v, [k], levels[k])
    return sorted(found)


@pytest.mark.parametrize("indent", [None, 4])
@pytest.mark.parametrize("block", [53, 100_000])
def test_json_entries(spark, tmp_path, indent, block):
    odd = ["plain", 'quote " inside', "comma, and } ] { [ signs", "back\\slash \\", 'end\\"', "Ü\u2028\n", "", " "]
    document = {
        "other": {"labels": {"x": {"y": [1, 2]}}, "z": [{"labels": 1}, 2]},
        "labels": {kind: {f"{t}{k}": odd[:k] for k, t in enumerate(odd)} for kind in ("units", "of, two", 'q"uoted')} | {"none": {}, "word": "text"},
        "statements": {str(k): [{"a": t, "n": {"deep": [k, {"x": "}"}]}} for t in odd[: k % 4]] for k in range(9)} | {"100": None, "101": -1.5, "102": {}},
        "flat": [1, {"a": "b, c"}], "last": {},
    }
    levels = {"labels": 3, "statements": 2, "flat": 1, "last": 2}
    (tmp_path / "d.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = documents.json_entries(spark, f"file://{tmp_path}/d.json", levels).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((tuple(r["keys"]), json.dumps(json.loads(r["value"]))) for r in found) == _entries(document, levels)


def test_json_entries_of_nothing(spark, tmp_path):
    for name, text in (("a", ""), ("b", "{}"), ("c", '{"x": {}}'), ("d", ' { "x" : { "k" : 5 } } ')):
        (tmp_path / f"{name}.json").write_text(text)
    found = documents.json_entries(spark, f"file://{tmp_path}", {"x": 2}).collect()
    assert [(r.file[-6:], r["keys"], r["value"]) for r in found] == [("d.json", ["x", "k"], "5")]


def test_endpoint_source(spark):
    endpoint.register(spark)
    answers = {"q1": '{"results": {"bindings": [{"item": {"value": "Q1"}}, {"item": {"value": "Q2"}, "label": {"value": "x"}}]}}', "q2": '{"results": {"bindings": [{"item": {"value": "Q3"}}, {"item": {"val'}
    rows = spark.read.format("sparql").schema("item string, label string").option("queries", json.dumps(["q1", "q2"])).option("stored", json.dumps(answers)).load().collect()
    assert sorted((r.item, r.label or "") for r in rows) == [("Q1", ""), ("Q2", "x"), ("Q3", "")]


class _Endpoint(BaseHTTPRequestHandler):
    """Twelve bindings for each query, by limit and offset; "flaky" fails at first, "broken" always, "cut" answers end early."""

    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):  # noqa: N802
        query = parse_qs(urlsplit(self.path).query)["query"][0]
        self.asked.append(query)
        name, _, limits = query.partition(" LIMIT ")
        if name == "broken" or (name == "flaky" and self.asked.count(query) == 1):
            self.send_error(503)
            return
        if name == "refused":
            self.send_error(400)
            return
        size, _, offset = limits.partition(" OFFSET ")
        rows = [{"item": {"value": f"{name}{k}"}} for k in range(12)][int(offset or 0) :][: int(size or 12)]
        text = json.dumps({"results": {"bindings": rows}})
        if name == "cut" and len(rows) > 2:
            text = text[: text.index(rows[2]["item"]["value"]) + 2]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())


@pytest.fixture
def served():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Endpoint)
    _Endpoint.asked.clear()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()
    server.server_close()


def test_endpoint_over_http(spark, served):
    endpoint.register(spark)
    names = ["plain", "flaky", "broken", "refused", "cut"]
    rows = (
        spark.read.format("sparql").schema("key string, item string, error string").option("queries", json.dumps({n: n for n in names}))
        .option("endpoint", served).option("page_size", 5).option("attempts", 2).option("pause", 0.01).load()
    )
    found = rows.collect()
    for name in ("plain", "flaky", "cut"):
        assert sorted(r.item for r in found if r.key == name) == sorted(f"{name}{k}" for k in range(12))
    assert {r.key: r.error for r in found if r.error} == {"broken": "HTTPError: HTTP Error 503: Service Unavailable", "refused": "HTTPError: HTTP Error 400: Bad Request"}
    asked = list(_Endpoint.asked)
    assert asked.count("refused LIMIT 5 OFFSET 0") == 1 and asked.count("broken LIMIT 5 OFFSET 0") == 2
    assert [q for q in asked if q.startswith("plain")] == [f"plain LIMIT 5 OFFSET {k}" for k in (0, 5, 10)]
    _Endpoint.asked.clear()
    assert rows.where("key = 'plain' AND item LIKE '%1'").count() == 2
    assert {q.split(" ")[0] for q in _Endpoint.asked} == {"plain"}
    assert {r.key for r in rows.where(F.col("key").isin("cut", "flaky")).collect()} == {"cut", "flaky"}
    bare = spark.read.format("sparql").schema("item string").option("queries", '["refused"]').option("endpoint", served).option("attempts", 1).load()
    with pytest.raises(Exception, match="400"):
        bare.collect()


def test_kept_answers(spark, served, tmp_path):
    path = f"file://{tmp_path}/answers"
    requests = spark.createDataFrame([("a", "plain"), ("b", "broken"), ("c", None)], "key string, query string")
    ask = endpoint.Http(served)
    endpoint.keep_answers(endpoint.fetched(requests, ask, size=5, attempts=1), path)
    rows = endpoint.stored(spark, path, ["item", "other"])
    found = rows.collect()
    assert sorted((r.page, r.item) for r in found if r.key == "a") == sorted((k // 5, f"plain{k}") for k in range(12))
    assert {r.key: r.error for r in found if r.error} == {"b": "HTTPError: HTTP Error 503: Service Unavailable", "c": "no query"}
    assert all(r.other is None for r in found)
    assert "PartitionFilters: [isnotnull(key" in rows.where("key = 'a'")._jdf.queryExecution().toString()
    again = endpoint.open_requests(requests, endpoint.kept_answers(spark, path))
    assert sorted(r.key for r in again.collect()) == ["b", "c"]
    assert endpoint.fetched(requests.limit(0), ask).collect() == []


def test_refreshed_answers(spark, served, tmp_path):
    path = f"file://{tmp_path}/answers"
    requests = spark.createDataFrame([("a", "plain"), ("b", "broken"), ("c", "flaky")], "key string, query string")
    endpoint.refreshed(requests, endpoint.Http(served), path, size=5, attempts=1)
    assert {r.key for r in endpoint.stored(spark, path, ["item"]).collect() if r.error} == {"b", "c"}
    _Endpoint.asked[:] = [q for q in _Endpoint.asked if q.startswith("flaky")]
    # Each page of the flaky query fails once, so the second run tries every page twice.
    endpoint.refreshed(requests, endpoint.Http(served), path, size=5, attempts=2, pause=0.01)
    rows = endpoint.stored(spark, path, ["item"]).collect()
    assert sorted(r.item for r in rows if r.key in "ac" and not r.error) == sorted(f"{n}{k}" for n in ("plain", "flaky") for k in range(12))
    assert [r.key for r in rows if r.error] == ["b"] and not any(q.startswith("plain") for q in _Endpoint.asked)


def test_fetch_command(spark, served, tmp_path):
    spark.createDataFrame([("a", "plain"), ("b", "cut")], "key string, query string").write.parquet(f"file://{tmp_path}/requests")
    cli.main(["fetch", "--requests", f"file://{tmp_path}/requests", "--output", f"file://{tmp_path}/answers", "--endpoint", served, "--page-size", "5"])
    rows = endpoint.stored(spark, f"file://{tmp_path}/answers", ["item"]).collect()
    assert len(rows) == 24 and not any(r.error for r in rows)


def test_page_requests(spark):
    titles = spark.createDataFrame([("A & B",), ("Ü|x",), ("A & B",), (None,)], "title string")
    calls = endpoint.page_info_requests(titles, "de", 1).orderBy("key").collect()
    assert [(r.key, r.titles) for r in calls] == [("1", ["A & B"]), ("2", ["Ü|x"])]
    assert calls[0].query == "https://de.wikipedia.org/w/api.php?action=query&prop=info&redirects=1&format=json&titles=A%20%26%20B"
    assert endpoint.page_info_requests(titles.limit(0)).collect() == []


def test_page_info(spark):
    answer = {"query": {"normalized": [{"from": "tower", "to": "Tower"}], "redirects": [{"from": "Tower", "to": "Iron Tower"}], "pages": {"7": {"pageid": 7, "ns": 0, "title": "Iron Tower"}, "8": {"pageid": 8, "ns": 1, "title": "Talk:X"}, "-1": {"ns": 0, "title": "Gone"}}}}
    answers = spark.createDataFrame([(json.dumps(answer),), ("not json",)], "json string")
    good, failed = endpoint.page_info(answers, spark.createDataFrame([("tower",), ("Talk:X",), ("Gone",), ("Other",)], "title string"))
    assert [(r.title, r.page_id, r.final) for r in good.collect()] == [("tower", 7, "Iron Tower")]
    assert {r.title: r.reason for r in failed.collect()} == {"Talk:X": "wrong_namespace", "Gone": "no_page_id_for_given_title", "Other": "no_page_id_for_given_title"}


def test_statements_from_triples(spark):
    rows = [
        ("P1", "wikibase:claim", "p:P1", None), ("P1", "wikibase:statementValue", "psv:P1", None), ("P1", "wikibase:propertyType", "wikibase:Quantity", None), ("P1", "rdfs:label", "height", "en"),
        ("E1", "p:P1", "st1", None), ("st1", "psv:P1", "n1", None), ("n1", "wikibase:quantityAmount", "324", None), ("n1", "wikibase:quantityUnit", "U1", None), ("n1", "wikibase:quantityLowerBound", "323", None), ("n1", "wikibase:quantityUpperBound", "325", None), ("a1", "schema:about", "E1", None),
        ("st1", "pq:P585", "2000", None), ("st1", "pqv:P585", "t1", None), ("t1", "wikibase:timePrecision", "9", None),
        ("E2", "p:P1", "st2", None), ("st2", "psv:P1", "n2", None), ("n2", "wikibase:quantityAmount", "7", None), ("n2", "wikibase:quantityUnit", "U1", None), ("n2", "wikibase:quantityLowerBound", "6", None), ("a2", "schema:about", "E2", None),
    ]
    triples = spark.createDataFrame(rows, schemas.TRIPLES)
    catalogue_rows = graph_patterns.property_catalogue(triples).collect()
    assert [(r.property, r.labels) for r in catalogue_rows] == [("P1", ["height"])]
    found = {r.entity: r for r in graph_patterns.statements(triples, spark.createDataFrame([("P1",)], "property string")).collect()}
    assert (found["E1"].lowerbound, found["E1"].qualifier, found["E1"].qualifier_time_precision) == ("323", "pq:P585", "9")
    assert found["E2"].lowerbound is None and found["E2"].qualifier is None
    grouped = {r.entity: r for r in statements.grouped(graph_patterns.statements(triples, spark.createDataFrame([("P1",)], "property string"))).collect()}
    assert grouped["E1"].qualifiers[0].time_precision == "9" and grouped["E2"].qualifiers == []


def test_titles(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "title string")
    normalised = spark.createDataFrame([("a", "A")], "source string, target string")
    redirected = spark.createDataFrame([("A", "Z"), ("b", "Y")], "source string, target string")
    assert {r.title: r.final for r in statements.final_titles(t, normalised, redirected).collect()} == {"a": "Z", "b": "Y", "c": "c"}


def test_context_reasons(spark):
    pages, facts, labels, conversions = catalogue.mini_corpus(spark)
    rows = context.examples(pages, facts, labels, conversions).collect()
    accepted = [r for r in rows if r.drop_reason is None]
    assert {(r.fact_id, r.unit) for r in accepted} == {(11, "Q11573"), (12, "Q11573"), (11, "Q3710")}
    assert all("entity" in r.annotations and "property" in r.annotations for r in accepted)
    without = context.examples(pages, facts, labels.where("kind <> 'properties'"), conversions)
    assert {r.drop_reason for r in without.collect()} == {"missing_alias_for_entity_or_property"}
    assert context.dataset(pages.limit(0), facts, labels, conversions).count() == 0


def test_context_is_the_whole_paragraph(spark):
    """All sentences of the paragraph, short ones too, and none of other paragraphs."""
    _, facts, labels, conversions = catalogue.mini_corpus(spark)
    early, late = [f"Line {k} says nothing." for k in range(60)], ["Too short.", *[f"Row {k} says nothing." for k in range(60)]]
    body = " ".join([*early, "The Iron Tower has a height of 324 metres.", *late])
    pages = spark.createDataFrame([(1, "T", [["Some other paragraph is here.", body, "A last one ends the page."]], [])], schemas.PAGES_PARSED)
    rows = [r for r in context.examples(pages, facts, labels, conversions).collect() if "324" in r.sentence]
    assert rows and all((r.context.before, r.context.after) == (early, late) for r in rows)


def test_with_context_has_no_cap(spark):
    rows = sequence.with_context(spark.range(130).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("string").alias("text")), ["k"], ["id"]).collect()
    for r in rows:
        assert (r.before, r.after) == ([str(n) for n in range(r.k, r.id, 2)], [str(n) for n in range(r.id + 2, 130, 2)])


def test_coreference_and_coordinates(spark):
    from quantspark.operators.matching import find_coordinates

    _, facts, labels, conversions = catalogue.mini_corpus(spark)
    pages = spark.createDataFrame([(1, "T", [["Start here. The Iron Tower stands in a town. It has a height of 324 metres."]], [])], schemas.PAGES_PARSED)
    rows = [r for r in context.examples(pages, facts, labels, conversions, spark.createDataFrame([("mile",)], "alias string")).collect() if r.drop_reason is None]
    assert [r.weak_accept_reasons for r in rows] == [["found_entity_with_coreference_resolution"]] and tuple(rows[0].annotations["entity"][0]) == (0, 2)
    assert find_coordinates("At 48.858412, 2.294500 exactly.", "Point(2.2945 48.8584)") == [(3, 12), (14, 22)]
    assert find_coordinates("At 48.8584 alone.", "Point(2.2945 48.8584)") == [] and find_coordinates("x", None) == []


def test_quantity_reasons(spark):
    pages = spark.createDataFrame([(1, "T", [["The tower is "], [" tall and was built. It costs "], [" per day of work here. And 5 more are "], [" long in all."]], [["324 m"] * 3, ["10 kg"] * 3, ["7 km"] * 3])], schemas.PAGES_PARSED)
    rows = {r.sentence: r.drop_reason for r in quantity.examples(pages).collect()}
    assert rows == {"The tower is 324 m tall and was built.": None, "It costs 10 kg per day of work here.": "per", "And 5 more are 7 km long in all.": "other_number"}


def test_unit_counts(spark):
    _, facts, labels, conversions = catalogue.mini_corpus(spark)
    pages = spark.createDataFrame([(1, "T", [["5 m and 6 ft and 7 m"]], [["1 m", "3 ft", "1 m (3 ft)"]]), (2, "U", [["no unit"]], [])], schemas.PAGES_PARSED)
    counted, without = unit_frequencies.count(pages, facts, conversions, labels, statements.stop_words(spark))
    got = {(r["mode"], r["qid"]): r["n"] for r in counted.collect()}
    assert got == {("full_text", "Q11573"): 2, ("full_text", "Q3710"): 1, ("quantities", "Q11573"): 1, ("quantities", "Q3710"): 1} and without.count() == 0
    assert [r.qid for r in frequency.top(counted.where("mode = 'full_text'")).collect()] == ["Q11573"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "ns": 0, "title": "T", "text": "It is 5 m and 6 m."}\n{"id": 2, "ns": 1, "title": "X", "text": "7"}\n{"id": 3, "ns": 0, "title": "R", "text": "#REDIRECT [[T]]"}\n')
    stream = page_stream.number_stream(page_stream.article_stream(page_stream.page_stream(spark, f"file://{tmp_path}/in")))
    page_stream.write(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert [(r.id, r.n_numbers) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(1, 2)]


def test_command_line(spark, dump_path, tmp_path):
    cli.main(["parse", "--dump", dump_path, "--output", f"file://{tmp_path}/pages"])
    assert tables.read_pages(spark, f"file://{tmp_path}/pages").count() == 1
    assert cli.parser().parse_args(["datasets", "--pages", "p", "--knowledge", "k", "--output", "o"]).skip_context is False


def test_datasets_from_the_command_line(spark, tmp_path):
    """Both datasets with unit frequencies read back, dropped examples and statistics."""
    pages, facts, labels, conversions = catalogue_jobs.tower_pages(spark, "/root/testdata/sf0.001")
    at = lambda name: f"file://{tmp_path}/{name}"
    tables.write_json_lines(pages, at("pages"))
    tables.write_knowledge({"facts": facts, "labels": labels, "unit_conversions": conversions}, at("knowledge"))
    cli.main(["unit-frequencies", "--pages", at("pages"), "--knowledge", at("knowledge"), "--output", at("frequencies")])
    cli.main(["datasets", "--pages", at("pages"), "--knowledge", at("knowledge"), "--output", at("out"), "--unit-frequencies", at("frequencies"), "--dropped", at("dropped"), "--statistics", at("statistics"), "--skip-quantities"])
    kept, counts = spark.read.json(at("out/context")).count(), {r.key: r.n for r in spark.read.json(at("statistics")).collect()}
    assert kept == counts["number_of_examples"] > 0 and counts["multiple_values"] == spark.read.json(at("dropped/context")).where("drop_reason = 'multiple_values'").count() > 0


def test_band_join_has_equal_keys(spark):
    df = catalogue.value_match_band_join(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    plan = catalogue.missing_mapping_antijoin(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_reasons_are_known():
    from quantspark.operators import filters

    assert len(set(filters.DROPPED)) == len(filters.DROPPED) and len(filters.WEAK) == 6


def test_bounds_include_their_ends(spark, tmp_path):
    """1.3 - 1.5 and 0.1 + 2.5 as sums of doubles miss the stated values that equal them."""
    spark.createDataFrame([(1, 0, -0.2), (2, 0, 3.8), (3, 0, -0.21), (4, 0, 3.81)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 0, 1.3)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(tuple(r) for r in catalogue.value_match_band_join(spark, str(tmp_path)).collect()) == [(1, 7, False, True), (2, 7, False, True)]
    assert tuple(catalogue.unique_exact_value(spark, str(tmp_path)).first()) == (7, "multiple_values", 2, 2)


def test_few_pairs_are_rounded_and_in_many_tasks(spark, tmp_path):
    """Stated values of one file are dealt out; only pairs that rounding may bring together reach Python, each once."""
    spark.range(2000).selectExpr("id AS c_custkey", "0 AS c_nationkey", "id * 2 / 100 AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 40).selectExpr("id AS s_suppkey", "0 AS s_nationkey", "CAST(id AS double) AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.value_match_band_join(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # above the union of the joins and their filters
    assert plan.index("ArrowEvalPython") < plan.index("Union") < plan.index("Join")
    assert df.rdd.getNumPartitions() > 4
    # The pairs as they stand before any filter, in plain Python.
    from quantspark.functions.units import rounded_error

    stated, targets = (x.collect() for x in catalogue.stated_and_targets(spark, str(tmp_path)))
    want = set()
    for t in targets:
        for n in stated:
            inside, error = t.low is not None and t.low <= n.value <= t.high, abs(n.value - t.target) / max(abs(t.target), 2.220446049250313e-16)
            rounded = rounded_error(t.target_text, n.text, n.value) if error > 0.03 and abs(t.target) < 0.5 / 0.03 else None
            by_rounding = not inside and rounded is not None and rounded <= 0.03
            if inside or error <= 0.03 or by_rounding:
                want.add((n.c_custkey, t.s_suppkey, by_rounding, inside))
    assert {tuple(r) for r in df.collect()} == want and sum(r[2] for r in want) > 100


def test_pages_of_other_namespaces_keep_their_ids(spark):
    """Such a page fails, but what the service says of it isn't lost."""
    from quantspark.sources import endpoint

    answers = spark.createDataFrame([('{"query": {"pages": {"4": {"pageid": 11, "ns": 1, "title": "a"}, "5": {"ns": 0, "title": "b"}}}}',)], "json string")
    good, failed = endpoint.page_info(answers, spark.createDataFrame([("a",), ("b",)], "title string"))
    assert good.count() == 0 and sorted(map(tuple, failed.select("title", "page_id", "reason").collect())) == [("a", 11, "wrong_namespace"), ("b", None, "no_page_id_for_given_title")]
