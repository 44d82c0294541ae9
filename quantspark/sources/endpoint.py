"""Query endpoints: requests page by page with retries, failures as rows, kept answers, repair of answers that were cut.

Two ways lead to an endpoint. ``spark.read.format("sparql")`` asks one query for each partition, and a filter on the key
column leaves out the requests of other keys. ``fetched`` takes its requests from a table of any size and gives answers
that ``keep_answers`` writes by key and ``stored`` reads again, so that later runs work offline. Neither passes answers
through the driver, and a request that fails is a row with its reason, never an empty answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

ENDPOINT = "https://query.wikidata.org/sparql"
ROWS_PER_QUERY, URIS_PER_QUERY, TITLES_PER_CALL, TIMEOUT = 250_000, 250, 50, 60
ATTEMPTS, PAUSE = 4, 2.0
#: Answers that another attempt may mend: too many requests, and faults of the server.
RETRIED = frozenset((429, 500, 502, 503, 504))


def repair_bindings(text: str) -> dict:
    """A JSON answer, or what is whole of one that the server cut off; anything else gives no rows.

    A cut answer ends within a record: it is cut back to the last record that ends, and brackets are closed.
    """
    empty = {"results": {"bindings": []}}
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    start = text.find('"bindings"')
    if start < 0:
        return empty
    end = max(text.rfind("} }", start), text.rfind("}}", start), text.rfind("}\n    }", start))
    while end > start:
        stop = text.find("}", text.find("}", end) + 1) + 1
        try:
            return json.loads(text[:stop] + "]}}")
        except json.JSONDecodeError:
            end = max(text.rfind("} }", start, end), text.rfind("}}", start, end), text.rfind("}\n    }", start, end))
    return empty


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _repaired(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([[list(row) for row in flat(repair_bindings(t), n.split(" "))] for t, n in zip(texts, names, strict=True)])


def bindings_of(answers: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``answers`` with a row for each binding of a stored, perhaps cut answer; its variables as columns ``names``."""
    rows = answers.withColumn("__b", F.explode(_repaired(F.col(text), F.lit(" ".join(names)))))
    return rows.select("*", *[F.get("__b", F.lit(k)).alias(n) for k, n in enumerate(names)]).drop("__b", text)


def flat(answer: dict, names: list[str]) -> Iterator[tuple]:
    """Rows of an answer: the value of each variable, None where it is unbound."""
    for binding in answer.get("results", {}).get("bindings", []):
        yield tuple(binding.get(n, {}).get("value") for n in names)


def asked(ask: Callable[[str], str], text: str, attempts: int = ATTEMPTS, pause: float = PAUSE) -> str:
    """The answer to ``text``; failures that may pass are tried again after pauses that double, the last one is raised."""
    for k in range(attempts):
        try:
            return ask(text)
        except OSError as e:
            if k + 1 == attempts or (isinstance(e, HTTPError) and e.code not in RETRIED):
                raise
            time.sleep(pause * 2**k)
    raise ValueError("attempts must be positive")


def _whole(text: str) -> bool:
    try:
        json.loads(text)
    except json.JSONDecodeError:
        return False
    return True


def paged(ask: Callable[[str], str], query: str, size: int | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Iterator[tuple[int, str | None, str | None]]:
    """(page, answer, error) of a query, ``size`` rows at a time until a page isn't full; without ``size``, in one.

    A page that was cut off is followed by one that starts after its last whole row. An answer of which nothing can be
    read, or a request that fails for good, ends the query with an error.
    """
    page = offset = 0
    while True:
        try:
            answer = asked(ask, query if size is None else f"{query} LIMIT {size} OFFSET {offset}", attempts, pause)
        except OSError as e:
            yield page, None, f"{type(e).__name__}: {e}"
            return
        n, whole = len(repair_bindings(answer).get("results", {}).get("bindings", [])), _whole(answer)
        if not whole and n == 0:
            yield page, None, "unreadable answer"
            return
        yield page, answer, None
        if size is None or (whole and n < size):
            return
        page, offset = page + 1, offset + n


class Http:
    """Asks ``endpoint`` for JSON: the text is the value of ``parameter``, or the address itself where that is None."""

    def __init__(self, endpoint: str = ENDPOINT, parameter: str | None = "query"):
        self.endpoint, self.parameter = endpoint, parameter

    def __call__(self, text: str) -> str:
        url = text if self.parameter is None else f"{self.endpoint}?{urlencode({self.parameter: text, 'format': 'json'})}"
        with urlopen(Request(url, headers={"Accept": "application/sparql-results+json"}), timeout=TIMEOUT) as found:
            return found.read().decode("utf-8", "replace")


def fetched(requests: DataFrame, ask: Callable[[str], str], size: int | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """``requests`` (key, query) as (key, page, answer, error); of a page, either the answer or the error is null.

    A null query gives one row with the error ``no query``. Each task asks its own requests one after another; how many
    run at a time is the number of partitions that the caller gives ``requests``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, query in zip(batch["key"], batch["query"], strict=True):
                found = [(0, None, "no query")] if query is None else paged(ask, query, size, attempts, pause)
                for row in found:
                    yield pd.DataFrame([(key, *row)], columns=["key", "page", "answer", "error"])

    return requests.select("key", "query").mapInPandas(run, ANSWERS)


ANSWERS = "key string, page int, answer string, error string"


def keep_answers(answers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Answers as a folder for each key, so that a reader that filters on keys opens theirs alone."""
    answers.write.mode(mode).partitionBy("key").parquet(path)


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, page, answer, error) as ``keep_answers`` wrote them."""
    return spark.read.schema(ANSWERS).parquet(path)


def open_requests(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (key, query) whose answers aren't there or end in an error: those that another run has to ask."""
    state = answers.groupBy("key").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return requests.join(state.where("NOT failed"), "key", "left_anti")


def refreshed(requests: DataFrame, ask: Callable[[str], str], path: str, **how) -> None:
    """Ask what ``path`` has no whole answer to yet and keep it there; a key that is asked again loses its old pages.

    So a run that was stopped, or met failures, is followed by one that asks the rest alone. Other arguments are those of
    ``fetched``.
    """
    from quantspark.sources.tables import cut, exists

    spark = requests.sparkSession
    wanted = cut(open_requests(requests, kept_answers(spark, path))) if exists(spark, path) else requests
    fetched(wanted, ask, **how).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("key").parquet(path)


def stored(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Kept answers as (key, page, *names, error): a row for each binding, and one for each page that failed."""
    answers = kept_answers(spark, path)
    good = bindings_of(answers.where("answer IS NOT NULL").drop("error"), "answer", names).withColumn("error", F.lit(None).cast("string"))
    failed = answers.where("answer IS NULL").select("key", "page", *[F.lit(None).cast("string").alias(n) for n in names], F.coalesce("error", F.lit("no answer")).alias("error"))
    return good.unionByName(failed)


class _Query(InputPartition):
    def __init__(self, key: str, text: str, stored: str | None):
        self.key, self.text, self.stored = key, text, stored


class SparqlReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.key = options.get("key", "key")
        queries = json.loads(options.get("queries", "[]"))
        self.queries = queries if isinstance(queries, dict) else {q: q for q in queries}
        self.endpoint = options.get("endpoint", ENDPOINT)
        self.stored = json.loads(options["stored"]) if "stored" in options else None
        size = options.get("page_size")
        self.how = (int(size) if size else None, int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and membership of the key choose the requests; Spark evaluates all else."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.queries = {k: q for k, q in self.queries.items() if k in wanted}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # Each partition carries its own stored answer alone.
        return [_Query(k, q, None if self.stored is None else self.stored.get(q, "")) for k, q in self.queries.items()]

    def read(self, partition: _Query) -> Iterator[tuple]:
        names = [n for n in self.fields if n not in (self.key, "error")]
        found = paged(Http(self.endpoint), partition.text, *self.how) if partition.stored is None else paged(lambda _: partition.stored, partition.text)
        for _, answer, error in found:
            if error and "error" not in self.fields:
                raise OSError(f"{partition.key}: {error}")
            rows = [(None,) * len(names)] if error else flat(repair_bindings(answer), names)
            for row in rows:
                value = dict(zip(names, row, strict=True)) | {self.key: partition.key, "error": error}
                yield tuple(value[n] for n in self.fields)


class SparqlSource(DataSource):
    """A row for each binding. Options: ``queries`` (a JSON object of key to query, or a list, whose queries are their own
    keys), ``key`` (the name of the key's column), ``endpoint``, ``page_size``, ``attempts``, ``pause`` (seconds before
    the second attempt), ``stored`` (a JSON object of query to answer, for a handful of them).

    The schema names the variables to read, besides the key and ``error`` where they are wanted. A request that fails is
    a row with its error; in a schema without that column it fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> SparqlReader:
        return SparqlReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format "sparql" known, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SparqlSource)


def chunks(items: list[str], size: int = URIS_PER_QUERY) -> list[list[str]]:
    return [items[k : k + size] for k in range(0, len(items), size)]


def label_query(uris: list[str], language: str = "en") -> str:
    """The query for labels and other names of items."""
    named = " ".join(uris)
    return f'SELECT ?item ?label WHERE {{ VALUES ?item {{ {named} }} ?item rdfs:label|skos:altLabel ?label . FILTER(LANG(?label) = "{language}") }}'


_PAGE_INFO = "query STRUCT<normalized: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, redirects: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, pages: MAP<STRING, STRUCT<pageid: LONG, ns: INT, title: STRING>>>"


def page_info_requests(titles: DataFrame, language: str = "en", size: int = TITLES_PER_CALL) -> DataFrame:
    """(key, query, titles): the page service's addresses for distinct ``titles``, ``size`` in each; null titles ask nothing."""
    from quantspark.operators.statements import chunked

    calls = chunked(titles.select("title").where("title IS NOT NULL").distinct(), "title", size=size)
    calls = calls.groupBy(F.col("chunk").cast("string").alias("key")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    listed = F.replace(F.url_encode(F.array_join("titles", "|")), F.lit("+"), F.lit("%20"))
    start = f"https://{language}.wikipedia.org/w/api.php?action=query&prop=info&redirects=1&format=json&titles="
    return calls.select("key", F.concat(F.lit(start), listed).alias("query"), "titles")


def page_mappings(titles: DataFrame, ask: Callable[[str], str] | None = None, language: str = "en", size: int = TITLES_PER_CALL, at_once: int = 4, **how) -> tuple[DataFrame, DataFrame]:
    """Page ids of ``titles`` by the page service, as ``page_info``; titles of a call that failed have its error as reason.

    ``at_once`` calls run at a time.
    """
    from quantspark.sources.tables import cut

    requests = page_info_requests(titles, language, size)
    # Kept, so that both results come of one round of calls.
    answers = cut(fetched(requests.repartition(at_once), ask or Http(parameter=None), **how))
    failed = answers.where("error IS NOT NULL").join(requests, "key").select(F.explode("titles").alias("title"), F.col("error").alias("reason"))
    reached = titles.select("title").join(failed, "title", "left_anti")
    good, missing = page_info(answers.where("answer IS NOT NULL").select(F.col("answer").alias("json")), reached)
    return good, missing.unionByName(titles.select("title").join(failed, "title"), allowMissingColumns=True)


def page_info(answers: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored page-info answers (json) and requested ``titles`` as (title, page_id, final) and (title, page_id, reason).

    Titles go through normalisation and redirects; a title without a page or outside the article namespace fails. The id of
    a page in another namespace is given as well.
    """
    from quantspark.operators.statements import final_titles

    parsed = answers.select(F.from_json("json", _PAGE_INFO).alias("a")).where("a.query IS NOT NULL")
    moves = [parsed.select(F.inline(f"a.query.{k}")).toDF("source", "target").distinct() for k in ("normalized", "redirects")]
    pages = parsed.select(F.explode("a.query.pages").alias("key", "p")).select("p.pageid", "p.ns", F.col("p.title").alias("final")).distinct()
    found = final_titles(titles, *moves).join(pages, "final", "left")
    good = found.where("pageid IS NOT NULL AND ns = 0").select("title", F.col("pageid").alias("page_id"), "final")
    reason = F.when(F.col("pageid").isNull(), "no_page_id_for_given_title").otherwise("wrong_namespace")
    return good, found.where("pageid IS NULL OR ns <> 0").select("title", F.col("pageid").alias("page_id"), reason.alias("reason"))
