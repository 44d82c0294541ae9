"""Jobs that go on after they were stopped: work by parts of the input, each named in a ledger once it is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.sources.tables import exists

_LEDGER = "part int, n_parts int, columns string"


def run_in_parts(rows: DataFrame, key: str, n_parts: int, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``work`` over all of ``rows``, one hash part of ``key`` after another, as a table under ``path``.

    A part's rows are written first, then it is named in the ledger; a call on the same ``path`` leaves out what the
    ledger names and writes anew what was begun and isn't named. ``work`` must give a part's rows from that part alone.
    Each part is a Spark job over about 1 / ``n_parts`` of the rows, so ``n_parts`` follows from how much work may be
    lost, not from the size of the cluster. A different ``n_parts`` for the same ``path`` is refused.
    """
    spark = rows.sparkSession
    ledger, data = f"{path}/ledger", f"{path}/data"
    done = spark.read.schema(_LEDGER).parquet(ledger).collect() if exists(spark, ledger) else []
    if any(r.n_parts != n_parts for r in done):
        raise ValueError(f"{path} was begun with {done[0].n_parts} parts")
    finished, ddl = {r.part for r in done}, done[0].columns if done else None
    own = F.pmod(F.xxhash64(F.col(key)), F.lit(n_parts))
    for part in range(n_parts):
        if part in finished:
            continue
        made = work(rows.where(own == part))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        made.write.mode("overwrite").parquet(f"{data}/part={part}")
        spark.createDataFrame([(part, n_parts, ddl)], _LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(ddl).parquet(*[f"{data}/part={k}" for k in range(n_parts)])
