"""The registry of queries: by name, each over whole tables, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over four tasks a core, where a scan has fewer: small files whose rows make much work, or many rows."""
    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, *keys) if rows.rdd.getNumPartitions() < n else rows


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table; the same rows stand in the query's SQL."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def made(spark: SparkSession, sf_dir: str, name: str, /, **columns: str) -> DataFrame:
    """A table with ``columns`` made of its rows by expressions that the query's SQL makes its expectations of, too."""
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def letters(number: str) -> str:
    """SQL for a word that spells a number's digits as letters, so that texts can name a row without a digit."""
    return f"upper(translate(CAST({number} AS STRING), '0123456789', 'qwxzvbnjkp'))"
