"""Jobs that are stopped, pages that fail, and counters that a job takes as it runs."""

import pytest
from pyspark.sql import functions as F

from quantspark import cli
from quantspark.plans import catalogue_jobs, context, parse, quantity, statistics
from quantspark.sources import tables
from quantspark.sources.ledger import run_in_parts
from quantspark.streaming import pages as page_stream
from quantspark.streaming.progress import Progress


class Killed(Exception):
    pass


def doubled(seen: list[int], stop_at: int | None):
    def work(rows):
        if len(seen) == stop_at:
            raise Killed
        seen.append(rows.count())
        return rows.select("id", (F.col("id") * 2).alias("twice"))

    return work


def test_a_stopped_job_goes_on(spark, tmp_path):
    rows = spark.range(200)
    whole = run_in_parts(rows, "id", 5, doubled([], None), f"file://{tmp_path}/whole")
    first, second, path = [], [], f"file://{tmp_path}/stopped"
    with pytest.raises(Killed):
        run_in_parts(rows, "id", 5, doubled(first, 3), path)
    # What was begun and isn't in the ledger is written anew.
    spark.range(7).selectExpr("id", "id AS twice").write.mode("overwrite").parquet(f"{path}/data/part=3")
    out = run_in_parts(rows, "id", 5, doubled(second, None), path)
    assert len(first) == 3 and len(second) == 2 and sum(first + second) == 200
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect())) == [(i, 2 * i) for i in range(200)]
    third = []
    assert run_in_parts(rows, "id", 5, doubled(third, 0), path).count() == 200 and third == []
    with pytest.raises(ValueError):
        run_in_parts(rows, "id", 6, doubled([], None), path)


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    bad = lambda rows: rows.select(F.when(F.col("id") == 50, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        run_in_parts(spark.range(100), "id", 4, bad, path)
    assert sorted(r.id for r in run_in_parts(spark.range(100), "id", 4, lambda rows: rows, path).collect()) == list(range(100))


def test_pages_that_fail(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "a", "It is {{convert|5|m}} long."), (2, "b", None), (None, None, ""), (3, "c", "{{convert|")], "id long, title string, text string")
    good, failed = parse.written_apart(pages, f"file://{tmp_path}/out")
    assert [tuple(r) for r in failed.collect()] == [(2, "b", "no_text")]
    assert sorted(str(r.id) for r in good.collect()) == ["1", "3", "None"] and parse.converted_pages(pages).count() == 3
    assert good.columns == ["id", "title", "text", "quantities"]


def test_equal_pages_stay_apart(spark):
    pages = parse.converted_pages(spark.createDataFrame([(1, "a", "It was made of {{convert|5|m|0}} of wood.")] * 2 + [(None, None, "There lie {{convert|7|m|0}} of rope.")] * 2, "id long, title string, text string"))
    assert len({r.sentence for r in quantity.examples(pages).collect()}) == 2 and quantity.examples(pages).count() == 4


def test_quantity_job_has_no_shuffle(spark):
    plan = quantity.examples(parse.converted_pages(spark.createDataFrame([(1, "a", "x")], "id long, title string, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_counters_come_from_the_pass_that_writes(spark, tmp_path):
    pages, facts, labels, conversions = catalogue_jobs.tower_pages(spark, "/root/testdata/sf0.001")
    seen = statistics.Observed("context")
    examples = seen.examples(context.examples(seen.pages(pages), facts, labels, conversions))
    examples.where("drop_reason IS NULL").write.parquet(f"file://{tmp_path}/out")
    got = {(r.category, r.key): r.n for r in seen.table().collect()}
    again = statistics.dataset_statistics(pages, {"context": context.examples(pages, facts, labels, conversions)})
    assert got == {(r.category, r.key): r.n for r in again.collect()}
    assert got["counts", "number_of_examples"] == spark.read.parquet(f"file://{tmp_path}/out").count() < got["counts", "candidates"]


def test_unknown_reasons_are_counted(spark):
    rows = spark.createDataFrame([(None,), ("per",), ("of my own",)], "drop_reason string")
    seen = statistics.Observed("d")
    seen.pages(rows).count()
    seen.examples(rows).collect()
    assert {(r.category, r.key): r.n for r in seen.table().collect()} == {("counts", "analyzed_pages"): 3, ("counts", "candidates"): 3, ("counts", "number_of_examples"): 1, ("dropped_cause", "per"): 1, ("dropped_cause", "other"): 1}


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"id": {10 * k + i}, "ns": 0, "title": "T", "text": "It is 5 m."}}\n' for i in range(10)))
    listener = Progress(total=80, every=10)
    spark.streams.addListener(listener)
    try:
        stream = page_stream.number_stream(page_stream.article_stream(page_stream.page_stream(spark, f"file://{tmp_path}/in", files_per_batch=1)))
        page_stream.write(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows == 40 and [s.rows for s in listener.steps][-1] == 40 and len(listener.steps) == 4
    assert all(s.per_second > 0 and s.left > 0 for s in listener.steps) and listener.ended


def test_command_line_in_parts_and_errors(spark, tmp_path):
    pages, facts, labels, conversions = catalogue_jobs.tower_pages(spark, "/root/testdata/sf0.001")
    at = lambda name: f"file://{tmp_path}/{name}"
    tables.write_json_lines(pages, at("pages"))
    tables.write_knowledge({"facts": facts, "labels": labels, "unit_conversions": conversions}, at("knowledge"))
    for name, more in (("one", []), ("two", ["--parts", "2"])):
        cli.main(["datasets", "--pages", at("pages"), "--knowledge", at("knowledge"), "--output", at(name), "--statistics", at(f"{name}-statistics"), "--skip-quantities", *more])
    rows = [sorted(r.sentence for r in spark.read.json(at(f"{name}/context")).collect()) for name in ("one", "two")]
    counts = [{(r.category, r.key): r.n for r in spark.read.json(at(f"{name}-statistics")).collect()} for name in ("one", "two")]
    assert rows[0] == rows[1] and rows[0] and counts[0] == counts[1]
