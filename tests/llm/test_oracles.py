"""Registered text queries against their SQL, and the shape of the registry."""

import duckdb
import pytest

from orrery.llm import registry
from tests.test_oracles import rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    at = f"/root/testdata/{size}"
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{at}/{name_}.parquet'")
    assert rows(registry.QUERIES[name](spark, at).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def test_one_query_of_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
