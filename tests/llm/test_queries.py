"""The found queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from docloom.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, data)
    names = ", ".join(f'"{n}"' for n in df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, c.execute(f"SELECT {names} FROM ({SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0
