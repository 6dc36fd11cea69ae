import html
import random
import re

from docloom.llm.near import groups, near_duplicates, pairs
from pyspark.sql import functions as F

KIND = "document_id long, text string, cls string, n int, s array<int>"


def shingles(text, width):
    w = re.findall(r"[^\W_]+", html.unescape(text or "").lower())
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def fixture():
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(25, 120))] for _ in range(25)]
    rows = []
    for k in range(120):
        w = [*rng.choice(base)]
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(9))], [w[at], "ins"]])
        rows.append((k, " ".join(w), "x", 1, [1]))
    rows += [(200, None, "x", 1, [1]), (201, "", "x", 1, [1]), (202, "few words", "x", 1, [1]), (None, rows[0][1], "x", 1, [1]), rows[3], (203, rows[5][1].upper() + " !", "x", 1, [1]), (204, " ".join(f"v{k}" for k in range(20_000)), "x", 1, [1]), (205, "caf&eacute; &amp; " * 20, "x", 1, [1])]
    return rows


def brute(rows, width, threshold):
    sets = {i: shingles(t, width) for i, t, *_ in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, KIND)
    for width, threshold in ((3, 0.5), (5, 0.8)):
        want = brute(rows, width, threshold)
        near = near_duplicates(df, "document_id", F.col("text"), width, threshold)
        found = [tuple(r) for r in pairs(near).collect()]
        assert len(want) > 15 and set(found) == want and len(found) == len(want)
        per = {r.document_id: r for r in groups(near).collect()}
        assert {i: r.links + r.copies for i, r in per.items()} == {i: sum(i in p for p in want) for i in per}
        assert all(per[a].group_id == per[b].group_id for a, b in want)


def test_hot_parts_are_cut_into_blocks(spark, monkeypatch):
    from docloom.llm import near as module

    monkeypatch.setattr(module, "PART_POSTINGS", 40)
    rows = fixture()
    found = [tuple(r) for r in pairs(near_duplicates(spark.createDataFrame(rows, KIND), "document_id", F.col("text"), 3, 0.5)).collect()]
    assert set(found) == brute(rows, 3, 0.5) and len(found) == len(set(found))
    monkeypatch.setattr(module, "PART_POSTINGS", 1)
    rows = [(k, "a b c d e " + " ".join(f"x{j}" for j in range(k % 3)), "x", 1, [1]) for k in range(30)]
    near = near_duplicates(spark.createDataFrame(rows, KIND), "document_id", F.col("text"), 1, 0.5)
    assert {tuple(r) for r in pairs(near).collect()} == brute(rows, 1, 0.5)


def test_empty_table(spark):
    near = near_duplicates(spark.createDataFrame([], KIND), "document_id", F.col("text"))
    assert pairs(near).count() == 0 and groups(near).count() == 0


def test_several_texts_under_one_id(spark):
    """One of the texts of an id is taken, the same each time; rows that repeat whole count once."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, words(1)), (1, words(2)), (1, words(1)), (2, words(1)), (3, words(2)), (2, words(1))]
    made = [near_duplicates(spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in order], KIND), "document_id", F.col("text"), 3, 0.5) for order in (rows, rows[::-1])]
    found = [{tuple(r) for r in pairs(near).collect()} for near in made]
    assert found[0] == found[1] and found[0] in ({(1, 2)}, {(1, 3)}) and groups(made[0]).count() == 3


def test_places_bound_the_sizes_that_are_met():
    """A token far back in a set leaves few others to share: only sets hardly larger are met under it, and none that can match is left out."""
    import numpy as np
    from docloom.llm.near import _farthest

    for threshold in (0.5, 0.8, 1.0):
        for size in range(1, 70):
            for j in range(int(size * (1 - threshold)) + 1):
                can = [n for n in range(size, 150) if size >= threshold * n - 1e-9 and size - j >= threshold / (1 + threshold) * (size + n) - 1e-9]
                assert max(can, default=0) == max(0, x if (x := int(_farthest(np.array([size]), np.array([size - j]), threshold)[0])) >= size else 0)
