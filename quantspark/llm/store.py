"""Shared folders and cut lineage for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then removes the shuffle files of an execution once it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a temporary folder is made under a local
    master alone, and any other master is refused, as its executors would not see the driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quantspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a query of its own, whose shuffle files go once it has run."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        yield df.select("*")
    finally:
        conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: computed once, kept in the shared folder.

    Files go to the reliable checkpoint store, so a lost executor costs no recomputation, and Spark's cleaner
    removes them when the frame is no longer referenced. The shuffles behind them are removed at once.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with _shuffles_removed(df) as query:
        return query.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> None:
    """Write ``df`` as a compressed table at ``path``; the shuffles behind it are removed."""
    with _shuffles_removed(df) as query:
        query.write.option("compression", "zstd").parquet(path)


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a compressed table of their own in the shared folder; for what is too large to ``cut``."""
    path = fresh_path(df.sparkSession, name)
    stored(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder at ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of this run in the shared folder, once all that was read from them has been cut."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
