"""Exact deduplication with a streaming, disk-backed keyed state.

Documents land as narrow rows: doc_id, digest of the normalised text, and a locator of their content, which is the file
that holds them and their row in it. The locator is also what names a row for good. A structured stream reads what has
landed and keeps, for each digest, the first row (smallest doc_id), where its content lies, and the number of rows. The
state has no watermark and no timeout, so it never expires; it lives in RocksDB on executors and in the shared folder,
and a later call on the same folder goes on where the last one stopped. Each hit is then checked: the full bytes of a
row, read again through its locator, are compared with those of the row that its digest points to, and rows that differ
in spite of equal digests are grouped by their bytes instead. Each text is normalised and hashed once; hits twice.

Hot groups: the stream combines rows of a digest before its shuffle, and the joins back have a shuffle on either
side and nothing above that needs a key's rows together, so Spark splits a large group over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm.store import cut, discard, fresh_path, stored

#: State lives on disk, and an executor closes a partition's state once its task has committed it to the shared folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _bare_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is no more than columns and rows of files as they are read, so that a row's place tells it apart."""
    if any(c.lower() == "_metadata" for c in docs.columns):
        return False
    node = docs._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in [c.lower() for c in node.schema().fieldNames()]


def located(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """``docs`` with ``__file`` and ``__row``, the locator of each row, and the table that had to be written for it.

    Rows of a plain scan have a place already (a hash of the file's path, and the row's number in it). All others are
    written as a table first: rows that a generator, a join or a sample repeats would have their file's place in common.
    """
    file, row = F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row")
    if _bare_scan(docs):
        try:
            return docs.select("*", file, row), None
        except AnalysisException:  # a source without files' metadata
            pass
    path = fresh_path(docs.sparkSession, "content")
    stored(docs, path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path).select("*", file, row), path


def _land(docs: DataFrame, path: str, digest: Callable[[Column], Column]) -> None:
    """Append located docs to the inbox as (doc_id, digest, file, row); texts stay where they are."""
    body = normalised(F.col("text"))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(body).alias("digest"), F.col("__file").alias("file"), F.col("__row").alias("row")).write.mode("append").parquet(path)


_INBOX = "doc_id long, digest string, file long, row long"


def update_state(spark: SparkSession, inbox: str, state: str) -> None:
    """Read what is new in ``inbox`` into the keyed state kept in ``state``; ends when nothing is left to read."""
    rows = spark.readStream.schema(_INBOX).parquet(inbox)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    keyed = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        query = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: digest, keep_id, keep_file, keep_row (the locator of the first row), group_size."""
    raw = spark.read.format("statestore").load(state)
    first, count = [f"value.`{f.name}`" for f in raw.schema["value"].dataType.fields]
    return raw.select(F.col("key.digest").alias("digest"), F.col(f"{first}.doc_id").alias("keep_id"), F.col(f"{first}.file").alias("keep_file"), F.col(f"{first}.row").alias("keep_row"), F.col(count).alias("group_size"))


def _bodies(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, row, ...) with the normalised text that lies there; texts elsewhere are not normalised."""
    texts = docs.select(F.col("__file").alias("file"), F.col("__row").alias("row"), "text")
    return texts.join(places, ["file", "row"]).withColumn("body", normalised(F.col("text"))).drop("text")


def _differing(docs: DataFrame, grouped: DataFrame, path: str) -> DataFrame:
    """The digests of which some row's bytes differ from those of the row that the digest points to.

    Hits alone are read again, by their locators: rows of groups of two or more.
    """
    spark = docs.sparkSession
    first = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    hits = grouped.where("group_size > 1").select("file", "row", "digest", first.alias("first"))
    stored(_bodies(docs, hits).select("digest", "first", "body"), path)
    texts = spark.read.schema("digest string, first boolean, body string").parquet(path)
    known = texts.where("first").select("digest", F.col("body").alias("first_body"))
    return cut(texts.where("NOT first").join(known, "digest").where("body <> first_body").select("digest"))


def _regroup(docs: DataFrame, grouped: DataFrame, bad: DataFrame) -> DataFrame:
    """``grouped`` with the groups of colliding digests formed again by their full bytes."""
    again = cut(_bodies(docs, grouped.join(bad, "digest", "left_semi").select("file", "row", "doc_id", "digest")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    keyed = again.groupBy("digest", "body").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    fixed = again.join(keyed, ["digest", "body"]).select("file", "row", "doc_id", "digest", F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"), F.col("first.doc_id").alias("keep_id"), "group_size")
    return grouped.join(bad, "digest", "left_anti").unionByName(fixed)


def _grouped(docs: DataFrame, digest: Callable[[Column], Column], folder: str, hits: str, all_docs: DataFrame) -> DataFrame:
    """Land ``docs`` in ``folder``, bring its state up to date, and group all rows landed there, whose texts are in ``all_docs``."""
    spark, inbox, state = docs.sparkSession, f"{folder}/inbox", f"{folder}/state"
    _land(docs, inbox, digest)
    update_state(spark, inbox, state)
    landed = spark.read.schema(_INBOX).parquet(inbox)
    grouped = cut(landed.join(read_state(spark, state), "digest"))
    bad = _differing(all_docs, grouped, hits)
    if not bad.isEmpty():
        grouped = cut(_regroup(all_docs, grouped, bad.distinct()))
    discard(spark, hits)
    return grouped


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """file, row, doc_id, digest, keep_file, keep_row, keep_id, group_size of each document.

    Needs doc_id and text; other columns are ignored. Null text counts as empty, null doc_ids come after all others,
    and of rows with equal doc_id and text the one with the smaller locator stays. An empty table gives an empty result.
    """
    found, folder, content, _ = _groups(docs.select("doc_id", "text"), digest)
    discard(docs.sparkSession, folder, *([content] if content else []))
    return found


def _groups(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, str, str | None, DataFrame]:
    """Groups, the folder of their state, the table of contents if one was written, and the rows as (doc, file, row)."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "dedup")
    # A row as one struct, so that no column of it clashes with the locator's.
    placed, content = located(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    texts = placed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "__file", "__row")
    return _grouped(texts, digest, folder, f"{folder}-hits", texts), folder, content, placed.select("doc", F.col("__file").alias("file"), F.col("__row").alias("row"))


def continued(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``groups`` over ``docs`` and all that earlier calls brought to the same ``folder``; the folder is kept for the next.

    The state goes on: only ``docs`` is hashed. Texts of earlier calls are read again where they are hits, so their
    files must still be there; what isn't read from Parquet is kept in the folder.
    """
    spark = docs.sparkSession
    placed, content = located(docs.select("doc_id", "text"))
    places = docs.select("doc_id", "text").select("_metadata.file_path").distinct() if content is None else spark.createDataFrame([(content,)], "file_path string")
    places.write.mode("append").parquet(f"{folder}/files")
    # One name for each file (or folder of files), not for rows.
    files = sorted({r.file_path for r in spark.read.schema("file_path string").parquet(f"{folder}/files").distinct().collect()})
    everything = spark.read.schema(placed.select("doc_id", "text").schema).parquet(*files)
    return _grouped(placed, digest, folder, fresh_path(spark, "hits"), located(everything)[0])


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each document doc_id, keep_id, group_size, kept and its digest as text_sha256."""
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return groups(docs, digest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with their columns as they were.

    Joined back by the locators of rows, so rows are told apart whatever their doc_id and text; the result is a table of
    its own, so that nothing reads the state or contents after their removal.
    """
    found, folder, _, rows = _groups(docs, digest)
    stay = found.where("file = keep_file AND row = keep_row").select("file", "row")
    discard(docs.sparkSession, folder)
    return rows.join(stay, ["file", "row"], "left_semi").select("doc.*")
