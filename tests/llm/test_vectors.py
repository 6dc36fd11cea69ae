import numpy as np
import pytest

from docloom.llm import clusters, proximity
from docloom.llm.vectors import parse, usable

KIND = "vec_id long, embedding array<float>, embedding_str string, rep long, vec string, cell int"


def fixture(seed=2, copies=True):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in (40, 25, 16, 14, 3):
        centre = rng.standard_normal(64)
        for _ in range(size):
            rows.append((k, centre + 0.35 * rng.standard_normal(64)))
            k += 1
    at, step = rng.standard_normal(64), rng.standard_normal(64)
    for j in range(20):  # a chain
        rows.append((k, at * np.cos(0.25 * j) + step * np.sin(0.25 * j)))
        k += 1
    rows += [(k + j, rng.standard_normal(64)) for j in range(60)]
    k += 60
    if copies:
        rows += [(k + j, rows[0][1]) for j in range(10)]
        stray = rng.standard_normal(64)
        rows += [(k + 10 + j, stray) for j in range(15)]
        k += 25
    return rows, k


def frame(spark, rows, k):
    f = lambda v: [float(x) for x in np.float32(v)]
    made = [(i, f(v), None, 1, "x", 1) if i % 5 else (i, None, str(f(v)), 1, "x", 1) for i, v in rows]
    bad = [(k, None, None), (k + 1, [0.0] * 64, None), (k + 2, [1.0] * 63, None), (k + 3, [float("nan")] * 64, None), (k + 4, [None] + [1.0] * 63, None), (k + 5, None, "[1, 2"), (k + 6, None, "[]"), (k + 7, [float("inf")] + [1.0] * 63, None), (None, [1.0] * 64, None)]
    return spark.createDataFrame([*made, made[1], *[(*b, 1, "x", 1) for b in bad]], KIND)


def cosines(rows):
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_parse():
    assert parse("[1, 2.5]") == parse(" [1 2.5] ") == [1.0, 2.5]
    assert parse("[a]") is None and parse("1,2") is None and parse(None) is None and parse("[]") == []


def test_clusters_are_the_chained_ones(spark):
    rows, k = fixture()
    near = cosines(rows) >= 0.8
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.where(near, label[None, :], len(rows)).min(1)
    want = {(rows[i][0], rows[int(label[i])][0]) for i in range(len(rows)) if (label == label[i]).sum() >= 15}
    vectors = usable(frame(spark, rows, k))
    found = clusters.similarity_clusters(vectors)
    assert {tuple(r) for r in found.collect()} == want
    described = clusters.describe(vectors, found).collect()
    assert {r.cluster_key for r in described} == {c for _, c in want} and all(r.place <= 5 for r in described)
    assert {r.cluster_key: r.size for r in described} == {c: sum(x == c for _, x in want) for _, c in want}


def test_links_near_the_threshold_are_kept(spark):
    """A stray x near a typical member of a cell is the only bridge to a member y that is near none; random clusters besides."""
    rng, e = np.random.default_rng(5), np.eye(64)
    x = 0.8 * e[0] + 0.3 * e[2] + 0.3 * e[1] + np.sqrt(1 - 0.82) * e[60]
    y = 0.87 * e[0] + np.sqrt(1 - 0.87**2) * e[1]
    made = [0.9 * e[0] + np.sqrt(0.19) * e[2 + j] for j in range(30)] + [x, y]
    for size in (119, 80, 60, 40, 25, 15):
        centre = rng.standard_normal(64)
        made += [centre + rng.choice([0.45, 0.5, 0.55]) * rng.standard_normal(64) for _ in range(size)]
    rows = list(enumerate(made))
    near = cosines(rows) >= 0.8
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.where(near, label[None, :], len(rows)).min(1)
    want = {(i, int(label[i])) for i, _ in rows if (label == label[i]).sum() >= 15}
    assert (31, 0) in want
    assert {tuple(r) for r in clusters.similarity_clusters(usable(frame(spark, rows, len(rows)))).collect()} == want


def test_feature_trees_merge(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([c + 0.02 * rng.standard_normal((50, 64)) for c in np.eye(64)[:5]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trees = [clusters.FeatureTree(64), clusters.FeatureTree(64), clusters.FeatureTree(64)]
    for k, v in enumerate(x):
        trees[k % 2].insert(1.0, v, float(v @ v))
    for t in trees[:2]:
        for n, ls, ss in zip(*t.features(), strict=True):
            trees[2].insert(n, ls, ss)
    count, linear, _ = trees[2].features()
    assert count.sum() == 250 and len(count) == 5
    assert len(clusters.ward(count, linear, 0.8)) == 5


def test_neighbours(spark):
    rows, k = fixture(copies=False)
    sims = cosines(rows)
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1)[:, :5]
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(rows)) for j in best[i] if sims[i, j] >= 0.8}
    vectors = usable(frame(spark, rows, k))
    found = {tuple(r) for r in proximity.close_pairs(proximity.nearest(vectors)).collect()}
    assert len(found & want) >= 0.98 * len(want) and len(found & want) >= 0.98 * len(found)
    few = proximity.nearest(vectors, 3, queries=vectors.where("vec_id % 20 = 0")).collect()
    assert {r.vec_id for r in few} == {i for i, _ in rows if i % 20 == 0} and max(r.place for r in few) == 3


def test_copies_are_neighbours(spark):
    rows, k = fixture()
    found = {}
    for r in proximity.nearest(usable(frame(spark, rows, k))).collect():
        found.setdefault(r.vec_id, []).append(r)
    stray = [i for i, _ in rows][-15:]
    assert all(len(found[i]) == 5 for i in stray)
    assert {r.other_id for r in found[stray[-1]]} == set(stray[:5])


def test_recall_of_one_graph():
    rng = np.random.default_rng(1)
    x = np.vstack([(c + 0.4 * rng.standard_normal((150, 64))) for c in rng.standard_normal((20, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    nodes, _ = proximity.Graph(x).search(x, proximity.QUERY_BEAM)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1)[:, :5]
    assert np.mean([len({*best[i]} & {*nodes[i, :6]}) / 5 for i in range(len(x))]) >= 0.95


@pytest.mark.parametrize("f", [lambda v: clusters.similarity_clusters(v), lambda v: proximity.nearest(v)])
def test_empty(spark, f):
    assert f(usable(spark.createDataFrame([], KIND))).count() == 0


def test_trees_keep_all_mass_and_many_clusters():
    """4,000 clusters of 20 in four trees that merge: nothing is thrown away and hardly a vector is far from all cells."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4_000, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 20, axis=0) + 0.03 * rng.standard_normal((80_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(len(x))]
    merged = clusters.FeatureTree(64)
    for part in range(4):
        tree = clusters.FeatureTree(64)
        tree.insert_many(x[part::4])
        assert round(tree.mass()) == 20_000
        for n, ls, ss in zip(*tree.features(), strict=True):
            merged.insert(n, ls, ss)
    assert round(merged.mass()) == 80_000
    count, linear, _ = merged.features()
    cells = clusters.ward(count[count > 1], linear[count > 1], 0.8)
    assert len(cells) >= 3_900
    assert ((x @ cells.T).max(1) < clusters.NEAR).mean() < 0.05


def test_small_trees_keep_all_mass():
    """Beyond their bounds trees move single vectors to the strays or grow their radius; the mass stays."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3_000, 16))
    x[:1_500] = np.repeat(x[:300], 5, axis=0) + 0.01 * rng.standard_normal((1_500, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(len(x))]
    for most in (32, 256):
        one, two = clusters.FeatureTree(16, most=most), clusters.FeatureTree(16, most=most)
        one.insert_many(x[:2_000])
        two.insert_many(x[2_000:])
        for tree, into in ((two, one), (two.strays, one.strays)):
            for n, ls, ss in zip(*tree.features(), strict=True):
                into.insert(n, ls, ss)
        assert round(one.mass()) == 3_000 and one.leaves <= most and one.strays.leaves <= clusters.STRAY_LEAVES


def test_far_vectors_meet(spark, monkeypatch):
    """Pairs of far vectors are found through hashes and hot buckets cut into blocks as by comparing all."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1_500:] = 0.82 * x[:1_500] + np.sqrt(1 - 0.82**2) * np.linalg.qr(rng.standard_normal((64, 64)))[0][rng.integers(0, 64, 1_500)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    sims = np.triu(x @ x.T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.8), strict=True)}
    far = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "rep long, vec binary")
    assert len(want) > 300
    for bucket, block in ((10_000, 10_000), (10_000, 400), (512, 10_000), (512, 20)):
        monkeypatch.setattr(clusters, "BUCKET", bucket)
        monkeypatch.setattr(clusters, "BUCKET_BLOCK", block)
        found = [tuple(r) for r in clusters.far_links(far, 0.8, 64).collect()]
        assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.995 * len(want)
        assert bucket < 10_000 or set(found) == want


def test_far_sketches_travel_a_few_tables_at_once(spark, monkeypatch):
    """With more far vectors not all tables' sketches are on disk at once, and the pairs stay the same."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64))
    x[300:] = x[:300] + 0.5 * rng.standard_normal((300, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    far = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "rep long, vec binary").coalesce(1)
    monkeypatch.setattr(clusters, "BUCKET", 100)
    rows, found = [], []
    made = clusters.cut
    for sketches in (10**9, 600):
        monkeypatch.setattr(clusters, "SKETCHES", sketches)
        rows.append([])
        monkeypatch.setattr(clusters, "cut", lambda df: rows[-1].append(df) or made(df))
        found.append({tuple(r) for r in clusters.far_links(far, 0.8, 64).collect()})
    assert found[0] == found[1] and len(found[0]) > 250
    assert len(rows[1]) > len(rows[0]) + 4  # a round of TABLES tables each


def test_shards_grow_in_number_and_not_in_size(spark, monkeypatch):
    """With ten times the rows a query goes to no more shards, shards are no larger, and neighbours are found."""
    monkeypatch.setattr(proximity, "LANDMARKS", 8)
    monkeypatch.setattr(proximity, "SHARD", 60)
    monkeypatch.setattr(proximity, "SAMPLE", 500)
    copies = {}
    for n in (600, 6_000):
        rng = np.random.default_rng(9)
        x = np.repeat(rng.standard_normal((n // 20, 64)), 20, axis=0) + 0.3 * rng.standard_normal((n, 64))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")[rng.permutation(n)]
        reps = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "rep long, vec binary")
        shards, rows, sizes = proximity.make_shards(reps, 64)
        assert rows.count() == n and rows.select("rep").distinct().count() == n
        assert sizes.agg({"n": "max"}).first()[0] <= 2 * proximity.SHARD and bool(shards.levels)
        parts = sizes.selectExpr("shard", "1 as parts")
        sent = proximity.send(reps, shards, parts).select("rep", "shard", "part").collect()
        assert len({r.rep for r in sent}) == n and len(sent) == len(set(sent))
        copies[n] = len(sent) / n
        found = proximity.nearest(reps.withColumnRenamed("rep", "vec_id"), 5).select("vec_id", "other_id").collect()
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        want = {(i, int(j)) for i, b in enumerate(np.argpartition(-sims, 5, axis=1)[:, :5]) for j in b}
        assert len({tuple(r) for r in found} & want) >= 0.9 * len(want)
    assert max(copies.values()) <= proximity.PROBES / 2


def test_pairs_are_found_across_many_shards(spark, monkeypatch):
    """Far more groups of like vectors than landmarks of one level: neighbours in other shards are found all the same."""
    monkeypatch.setattr(proximity, "LANDMARKS", 16)
    monkeypatch.setattr(proximity, "SHARD", 256)
    monkeypatch.setattr(proximity, "SAMPLE", 2_000)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((1_000, 64)), 12, axis=0) + rng.choice([0.2, 0.3, 0.4], 12_000)[:, None] * rng.standard_normal((12_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")[rng.permutation(12_000)]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = np.argpartition(-sims, 5, axis=1)[:, :5]
    want = {(min(i, int(j)), max(i, int(j))) for i in range(12_000) for j in best[i] if sims[i, j] >= 0.8}
    vectors = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "vec_id long, vec binary")
    found = {tuple(r) for r in proximity.close_pairs(proximity.nearest(vectors)).collect()}
    assert len(found & want) >= 0.98 * len(want)


def test_memory_of_a_task_is_bounded():
    """A full tree, a dense cell and a dense bucket take tens of MB, not hundreds."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)

    def peak(f):
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = clusters.FeatureTree(64)
    for v in x:
        tree.insert(2.0, 2 * v, 2.0)
    assert tree.leaves > 11_000
    assert peak(lambda: tree._absorb(x[:4_096])) < 150

    dense = (x[0] + 0.02 * rng.standard_normal((16_384, 64))).astype(np.float32)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    ids = np.arange(16_384)
    made = []
    assert peak(lambda: made.append(clusters._edges(ids[:2_048], dense[:2_048], ids, dense, 0.8))) < 150
    assert len(made[0]) == 16_383

    n = 3_000
    rows = pa.table({"key": [1] * n, "rep": range(n), **{f"s{k}": [5] * n for k in range(clusters.WORDS)}, "lo": [0] * n, "hi": [0] * n, "second": [False] * n})
    count = []
    assert peak(lambda: count.append(sum(b.num_rows for b in clusters._alike(rows, [f"s{k}" for k in range(clusters.WORDS)], 60, 100)))) < 150
    assert count == [n * (n - 1) // 2]
