"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quantspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
