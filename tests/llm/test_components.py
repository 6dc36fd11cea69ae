import random

import pytest

from docloom.llm.components import components, match_groups


def groups_of(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    return {x: find(x) for x in top}


CASES = {
    "chain": [(k, k + 1) for k in range(60)],
    "star": [(500, k) for k in range(80)],
    "random": [(a := random.Random(k).randrange(120), random.Random(k + 999).randrange(120)) for k in range(70)],
    "dirty": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (-7, 8), (8, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_union_find(spark, name):
    edges = CASES[name]
    df = spark.createDataFrame([(a, b, 1, 1) for a, b in edges], "a long, b long, x int, v int")
    assert {r.vertex: r.group_id for r in components(df).collect()} == groups_of(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matches(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (3, 2), (4, 4), (5, 6), (7, 8), (9, None), (10, 11)], "item1_id long, item2_id long")
    labels = [(2, 1, " Semantically-Identical\n"), (2, 3, "ONE doc_included"), (4, 4, "semantically_identical"), (5, 6, "not_semantically_identical"), (5, 6, None), (7, 8, "none_of_above"), (7, 8, "one_doc_included"), (12, 13, "one_doc_included"), (None, 9, "one_doc_included")]
    analysed = spark.createDataFrame(labels, "item1_id long, item2_id long, llm_relationship_type string")
    assert {tuple(r) for r in match_groups(pairs, analysed).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert match_groups(pairs.limit(0), analysed).count() == 0


def test_giant_components_get_their_names_by_broadcast(spark, monkeypatch):
    from docloom.llm import components as module

    monkeypatch.setattr(module, "GIANT", 5)
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, 101), (101, 102)]
    found = {r.vertex: r.group_id for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 10 for k in range(10, 41)} | {100: 100, 101: 100, 102: 100}
