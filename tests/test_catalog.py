"""Every query with SQL against DuckDB on the smallest tables, and every other one for its rows."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from docloom.plans.catalog import QUERIES, SQL  # noqa: E402


def plain(rows):
    def one(v):
        return "" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    if name not in SQL:
        assert rows or name in ("events_in_documents",)
        return
    quoted = ", ".join(f'"{n}"' for n in names)
    assert plain(rows) == plain(duck.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
