"""Page streams: new dump parts or JSON lines to parsed pages and number statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantspark import schemas
from quantspark.functions.numbers import number_spans
from quantspark.session import ship
from quantspark.sources.dump import in_namespaces, without_redirects


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Raw pages (id, ns, title, text) from JSON-lines files as they arrive."""
    return spark.readStream.schema(schemas.PAGES_RAW).option("maxFilesPerTrigger", files_per_batch).json(path)


def article_stream(pages: DataFrame, namespaces: tuple[int, ...] = (0,)) -> DataFrame:
    return without_redirects(in_namespaces(pages, namespaces))


def number_stream(pages: DataFrame) -> DataFrame:
    """(id, n_numbers) of each article: stateless, so its only state is which files have been read."""
    ship(pages.sparkSession)
    return pages.select("id", F.size(number_spans("text")).alias("n_numbers"))


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once; with ``once`` the query ends when all that is there has been read."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
