"""Parsing of dumps: articles to plain text, with conversion templates expanded or not."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark import schemas
from quantspark.functions.convert import expand
from quantspark.functions.text import clean_page, plain_text, split_at_templates
from quantspark.session import ship
from quantspark.sources.dump import DumpJob, articles


def parsed_page(markup: str) -> tuple[list[list[str]], list[list[str] | None]]:
    """Runs of paragraphs, and the expanded conversion templates between them (None where one can't be read)."""
    texts, templates = split_at_templates(clean_page(markup))
    runs = [plain_text(t) for t in texts]
    for k, (run, text) in enumerate(zip(runs, texts, strict=True)):
        # White space beside a template separates it from the text.
        if run and k and text[:1].isspace():
            run[0] = ("\n\n" if text.startswith("\n\n") else " ") + run[0]
        if run and k < len(templates) and text[-1:].isspace():
            run[-1] += "\n\n" if text.endswith("\n\n") else " "
    return runs, [expand(t) for t in templates]


def raw_pages(pages: DataFrame) -> DataFrame:
    """id, title, text of articles with their markup."""
    return pages.select("id", "title", "text")


def attempted_pages(pages: DataFrame) -> DataFrame:
    """id, title, text runs and quantities of articles; of a page that can't be parsed, the ``error`` in their place."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, title, markup in zip(pdf["id"], pdf["title"], pdf["text"], strict=True):
                if markup is None:
                    rows.append((page_id, title, None, None, "no_text"))
                    continue
                try:
                    rows.append((page_id, title, *parsed_page(markup), None))
                except Exception as e:  # noqa: BLE001  whatever a page does, it is the page that fails and not the job
                    rows.append((page_id, title, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "title", "text", "quantities", "error"])

    return pages.select("id", "title", "text").mapInPandas(run, f"{schemas.PAGES_PARSED}, error STRING")


def converted_pages(pages: DataFrame) -> DataFrame:
    """Pages that can be parsed: id, title, text runs and quantities. ``written_apart`` keeps the others, too."""
    return attempted_pages(pages).where("error IS NULL").drop("error")


def written_apart(pages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed pages, and (id, title, error) of the others: one scan that writes both as tables under ``path``."""
    attempted_pages(pages).withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(path)
    rows = pages.sparkSession.read.schema(f"{schemas.PAGES_PARSED}, error STRING, failed BOOLEAN").parquet(path)
    return rows.where("NOT failed").drop("error", "failed"), rows.where("failed").select("id", "title", "error")


def parse(spark: SparkSession, job: DumpJob) -> DataFrame:
    pages = articles(spark, job)
    return raw_pages(pages) if job.mode == "raw" else converted_pages(pages)
