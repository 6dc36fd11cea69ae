"""Queries whose limits bite only on larger tables, against their SQL there."""

from pathlib import Path

import pytest
from test_catalog import plain

from docloom.plans.catalog import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.01")
NAMES = [*(f"graph_{n}" for n in ("filtered", "filtered_nodes", "counts", "arcs", "ports", "widths", "visibility", "diff_records", "curves", "search")), "tfidf_vocab_bigrams", "label_status", "model_texts", "text_previews"]


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(NAMES))
def test_whole(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    assert plain(df.select(*[f"`{n}`" for n in names]).collect()) == plain(duck.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_whole_graph(spark, duck):
    links = QUERIES["graph_filtered"](spark, str(FOLDER)).collect()
    assert len(links) > 40
    partial = sum(r.relationship == "Partial inclusion" for r in links)
    found = QUERIES["graph_search"](spark, str(FOLDER)).collect()
    assert sum(r.relationship == "Partial inclusion" for r in found) == partial > 0


def test_whole_diffs(spark, duck):
    pairs = QUERIES["dup_pairs_labelled"](spark, str(FOLDER)).count()
    assert QUERIES["token_diffs"](spark, str(FOLDER)).count() == pairs > 50


def test_whole_best_pairs_of_copies(spark, tmp_path, monkeypatch):
    """Copies enough for all 500 pairs: no block is compared, and the smallest ids come first."""
    from docloom.operators import similarity

    rows = [(k, "en", "one text that many documents have" if k % 2 else None) for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(similarity, "_blocked", lambda *a: pytest.fail("blocks were compared"))
    found = [(r.item1_id, r.item2_id) for r in QUERIES["dup_pairs_labelled"](spark, str(tmp_path)).collect()]
    odd = range(1, 80, 2)
    assert sorted(found) == [(i, j) for i in odd for j in odd if i < j][:500]
