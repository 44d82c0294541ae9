"""One entry point with a sub-command for each job: ``spark-submit -m quantspark.cli parse --dump ...``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark import session
from quantspark.operators import frequency
from quantspark.operators.coreference import BACK_ENDS
from quantspark.operators.statements import stop_words
from quantspark.plans import context, knowledge, parse, quantity, statistics, unit_frequencies
from quantspark.sources import endpoint, tables
from quantspark.sources.dump import DumpJob, articles
from quantspark.sources.ledger import run_in_parts

log = logging.getLogger("quantspark")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quantspark")
    top.add_argument("--log-level", default="INFO")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse", help="dump to JSON lines of pages")
    p.add_argument("--dump", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--mode", choices=("raw", "convert"), default="convert")
    p.add_argument("--limit", type=int)
    p.add_argument("--page-offset", type=int, default=0)
    p.add_argument("--errors", help="also write pages that can't be parsed here")
    p.add_argument("--parts", type=int, help="work in so many parts, so that a stopped run can go on; the output is Parquet")
    a = sub.add_parser("fetch", help="ask an endpoint all requests that have no whole answer yet")
    a.add_argument("--requests", required=True, help="Parquet with key and query")
    a.add_argument("--output", required=True, help="answers, in a folder for each key")
    a.add_argument("--endpoint", default=endpoint.ENDPOINT)
    a.add_argument("--page-size", type=int, default=endpoint.ROWS_PER_QUERY)
    a.add_argument("--at-once", type=int, default=4, help="requests at a time")
    k = sub.add_parser("knowledge", help="triples to knowledge tables")
    for name in ("triples", "page-map", "unit-config", "output"):
        k.add_argument(f"--{name}", required=True)
    f = sub.add_parser("unit-frequencies", help="how often units are named")
    for name in ("pages", "knowledge", "output"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--modes", nargs="+", choices=unit_frequencies.MODES, default=list(unit_frequencies.MODES))
    f.add_argument("--limits", nargs="+", type=int)
    d = sub.add_parser("datasets", help="quantity and context datasets")
    for name in ("pages", "knowledge", "output"):
        d.add_argument(f"--{name}", required=True)
    d.add_argument("--skip-quantities", action="store_true")
    d.add_argument("--skip-context", action="store_true")
    d.add_argument("--unit-frequencies", help="what the unit-frequencies command wrote")
    d.add_argument("--frequent-percent", type=int, default=50)
    d.add_argument("--remove-infrequent-units", action="store_true")
    d.add_argument("--coreference", choices=tuple(BACK_ENDS), default="head_noun")
    d.add_argument("--dropped", help="also write dropped examples here")
    d.add_argument("--statistics", help="also write counts of reasons here")
    d.add_argument("--parts", type=int, help="work in so many parts of the pages, so that a stopped run can go on")
    return top


def datasets(spark: SparkSession, pages: DataFrame, known: dict[str, DataFrame], args: argparse.Namespace) -> None:
    """Both datasets, their dropped examples and statistics; all examples are made once, counted meanwhile, and read again."""
    conversions, frequent, made, counts = known["unit_conversions"], None, {}, []

    def all_examples(name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if args.parts:
            found = run_in_parts(pages, "id", args.parts, make, f"{args.output}/{name}-parts")
            counts.append(statistics.dataset_statistics(pages, {name: found}))
            return found
        seen = statistics.Observed(name)
        found = tables.cut(seen.examples(make(seen.pages(pages))))
        counts.append(seen.table())
        return found

    if args.unit_frequencies:
        counted = tables.read_frequencies(spark, args.unit_frequencies).groupBy("qid").agg(F.max("n").alias("n"))
        frequent = frequency.frequent_aliases(frequency.top(counted, args.frequent_percent), known["labels"])
        conversions = frequency.excluded(conversions, counted, frequency.unlabelled(counted.select("qid"), known["labels"]), args.remove_infrequent_units)
    if not args.skip_quantities:
        made["quantity"] = all_examples("quantity", quantity.examples)
        tables.write_examples(made["quantity"].where("drop_reason IS NULL").drop("drop_reason"), f"{args.output}/quantity", ["quantities"])
    if not args.skip_context:
        made["context"] = all_examples("context", lambda some: context.examples(some, known["facts"], known["labels"], conversions, frequent, args.coreference))
        tables.write_json_lines(context.reconciled_dataset(made["context"]), f"{args.output}/context")
    if args.dropped:
        for name, examples in made.items():
            tables.write_dropped(examples, f"{args.dropped}/{name}")
    if args.statistics and made:
        tables.write_json_lines(statistics.merged(*counts), args.statistics)


def read_known(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Knowledge tables from the folder that the knowledge command wrote, or from one JSON document."""
    return tables.read_knowledge_json(spark, path) if path.endswith(".json") else tables.read_knowledge(spark, path)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(message)s")
    spark = session.session()
    if args.command == "parse":
        job = DumpJob(args.dump, args.mode, args.limit, args.page_offset)
        if args.parts:
            make = parse.raw_pages if job.mode == "raw" else parse.converted_pages
            run_in_parts(articles(spark, job), "id", args.parts, make, args.output)
        elif args.errors and job.mode == "convert":
            work = tables.scratch(spark, "parsed")
            pages, failed = parse.written_apart(articles(spark, job), work)
            tables.write_json_lines(pages, args.output)
            tables.write_json_lines(tables.kept(failed, work), args.errors)
        else:
            tables.write_json_lines(parse.parse(spark, job), args.output)
    elif args.command == "fetch":
        session.ship(spark)
        requests = spark.read.parquet(args.requests).repartition(args.at_once)
        endpoint.refreshed(requests, endpoint.Http(args.endpoint), args.output, size=args.page_size)
    elif args.command == "knowledge":
        built = knowledge.build(spark.read.parquet(args.triples), spark.read.parquet(args.page_map), spark.read.parquet(args.unit_config), stop_words(spark))
        tables.write_knowledge(built, args.output)
    elif args.command == "unit-frequencies":
        known = read_known(spark, args.knowledge)
        limits = dict(zip(args.modes, args.limits, strict=True)) if args.limits else None
        counted, _ = unit_frequencies.count(tables.read_pages(spark, args.pages), known["facts"], known["unit_conversions"], known["labels"], stop_words(spark), tuple(args.modes), limits)
        counted.write.parquet(args.output)
    else:
        pages, known = tables.read_pages(spark, args.pages), read_known(spark, args.knowledge)
        datasets(spark, pages, known, args)
    log.info("%s: done", args.command)


if __name__ == "__main__":
    main()
