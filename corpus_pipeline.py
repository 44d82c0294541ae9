"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing of sources, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantspark.llm.stages import STAGES
from quantspark.llm.store import discard, fresh_path, stored

#: Tokenisers decide in two stages, which SQL can't express; tests hold the stages against brute force instead.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of documents. A stage's table is removed once the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stored(stage(spark, docs, sf_dir), path)
        if last:
            discard(spark, last)
        docs, last = spark.read.schema(docs.schema).parquet(path), path
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, last)
    return pieces
