"""Every registered catalog query against its SQL, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from orrery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "NULL"
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
