"""Encyclopedia dumps: (compressed) XML to page rows, redirect and namespace filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.operators.ranks import between


@dataclass(frozen=True)
class DumpJob:
    """What to read and how: ``mode`` is raw or convert."""

    path: str
    mode: str = "raw"
    limit: int | None = None
    page_offset: int = 0
    namespaces: tuple[int, ...] = (0,)

    def __post_init__(self) -> None:
        if self.mode not in ("raw", "convert"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def language(self) -> str:
        """The language in the file's name, as in ``enwiki-20220818-pages-articles.xml.bz2``."""
        name = self.path.rstrip("/").rsplit("/", 1)[-1]
        found = re.match(r"([a-z_]+?)wiki\b", name)
        return found[1] if found else "en"


_TEXT = T.StructType([T.StructField("_VALUE", T.StringType())])
_PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("id", T.LongType()),
    T.StructField("revision", T.StructType([T.StructField("text", _TEXT)])),
])

#: Pages and words of two editions at one snapshot, where no network is at hand (fixed values).
STATISTICS = {"en": {"articles": 6_571_321, "words": 4_185_916_131}, "simple": {"articles": 220_357, "words": 48_570_822}}


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, ns, title, text) of all pages of an XML dump; splittable where the codec is. A page's own id is read, not its revision's."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    return rows.select("id", "ns", "title", F.col("revision.text._VALUE").alias("text"))


def in_namespaces(pages: DataFrame, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    return pages.where(F.col("ns").isin(list(namespaces)))


def without_redirects(pages: DataFrame) -> DataFrame:
    return pages.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"^(?i:#REDIRECT)"))


def articles(spark: SparkSession, job: DumpJob) -> DataFrame:
    """Article rows of a job: filters first, so that ``offset`` and ``limit`` count articles."""
    pages = without_redirects(in_namespaces(read_dump(spark, job.path), job.namespaces)).where("text IS NOT NULL")
    return between(pages, "id", "title", "text", offset=job.page_offset, limit=job.limit)


def statistics(language: str) -> dict[str, int]:
    if language not in STATISTICS:
        raise ValueError(f"no statistics for {language!r}")
    return STATISTICS[language]
