"""Most similar vectors for every vector: robust-pruned directed graphs, one per shard.

Building inserts points in growing batches: a greedy search over the graph so far proposes
neighbours, and a neighbour is kept only if no kept one is much nearer to it than the point is
(pruning relaxed by ``ALPHA``), so that edges point in diverse directions.  A query is a beam search
in each shard it is sent to.  All searches of a batch run side by side in numpy.

Shards come from landmarks, in levels: those of the first are fitted on a bounded sample of all rows,
those of the next inside each shard, on a bounded sample of its rows, and so on.  So shards grow in
number with the data and not in size, and a query goes to ``PROBES`` of them at most, whatever the
number of rows.  All landmarks travel to the tasks: a row follows several ways down at once and compares
the finest landmarks only, so that like rows meet wherever the first levels part them.  Every row is
indexed.  The queries to a shard are cut into blocks, so neither a task's index nor its queries grow with
the data.  Exact copies are folded before and unfolded after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.vectors import folded, matrix
from docloom.session import cut, scratch, task_count

DEGREE, BEAM, QUERY_BEAM, ALPHA = 24, 40, 48, 1.2
#: Rows of the sample landmarks are fitted on, landmarks, rows of a shard (about), shards a query looks through, how much less like a landmark may be than the best, queries in one task.
SAMPLE, LANDMARKS, SHARD, PROBES, MARGIN, QUERIES_A_TASK = 20_000, 512, 4_096, 8, 0.2, 40_000
#: Levels of landmarks at most, and landmarks at which they end (64 MB).  What is too large even so is cut by hash.
MOST_LEVELS, MOST_MARKS = 4, 262_144
#: Landmarks per SHARD rows where there are several levels, and shards of a level that a row's way down goes through at most.
MARKS_A_SHARD, WAYS = 32, 16
#: Searches side by side, nodes of each looked around at a time.
_STEP, _ROUND = 512, 4


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many points at once: (len(points), degree) neighbours, -1 where there are no more."""
    n, c = candidates.shape
    out = np.full((n, degree), -1, np.int32)
    live = (candidates >= 0) & (candidates != points[:, None])
    vecs = x[candidates]
    far = np.where(live, 1 - np.einsum("ncd,nd->nc", vecs, x[points]), np.inf)
    between = 1 - np.matmul(vecs, vecs.transpose(0, 2, 1))
    rows = np.arange(n)
    for k in range(degree):
        best = far.argmin(1)
        has = np.isfinite(far[rows, best])
        if not has.any():
            break
        out[has, k] = candidates[rows, best][has]
        far[has & True, :] = np.where(alpha * between[rows, best][has] <= far[has], np.inf, far[has])
        far[rows, best] = np.inf
    return out


class Graph:
    """A directed proximity graph over unit vectors, with entry points spread over them."""

    def __init__(self, x: np.ndarray, near: np.ndarray | None = None, seed: int = 0):
        self.x = x
        n = len(x)
        self.entries = np.arange(min(n, max(8, int(16 * np.sqrt(n)))))  # rows come in random order
        if near is not None:
            self.near = near
            return
        self.near = np.full((n, DEGREE), -1, np.int32)
        done = min(n, 2 * DEGREE)
        if done > 1:  # the first few know each other
            everyone = np.tile(np.arange(done, dtype=np.int32), (done, 1))
            self.near[:done] = _prune(x, np.arange(done), everyone, DEGREE, ALPHA)
        while done < n:
            upto = min(n, 2 * done, done + _STEP)
            new = np.arange(done, upto)
            self._insert(new, done)
            done = upto

    def _insert(self, new: np.ndarray, done: int) -> None:
        found, _ = self.search(self.x[new], BEAM, done)
        # Points of one batch cannot find each other in the graph: offer the nearest of them too.
        sims = self.x[new] @ self.x[new].T
        np.fill_diagonal(sims, -2)
        k = min(8, len(new) - 1)
        if k > 0:
            found = np.hstack([found, new[np.argpartition(-sims, k - 1, axis=1)[:, :k]].astype(np.int32)])
        self.near[new] = _prune(self.x, new, found, DEGREE, ALPHA)
        # Back edges: each target weighs what it has and those who point to it now.
        source = np.repeat(new, DEGREE).astype(np.int32)
        target = self.near[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[source], self.x[target]), target))
        source, target = source[order], target[order]
        at, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        keep = place < DEGREE  # the nearest of those who point to it
        offered = np.full((len(at), DEGREE), -1, np.int32)
        offered[np.repeat(np.arange(len(at)), count)[keep], place[keep]] = source[keep]
        known = self.near[at]
        offered = np.where((offered[:, :, None] == known[:, None, :]).any(2), -1, offered)
        merged = np.hstack([known, offered])
        slack = (merged >= 0).sum(1) <= DEGREE
        if slack.any():  # room enough: nothing to prune
            rows = merged[slack]
            self.near[at[slack]] = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
        if not slack.all():
            self.near[at[~slack]] = _prune(self.x, at[~slack], merged[~slack], DEGREE, ALPHA)

    def search(self, queries: np.ndarray, beam: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query, best first (-1: none), and their cosines."""
        among = len(self.x) if among is None else among
        entries = self.entries[self.entries < among]
        out, sims = [], []
        for a in range(0, len(queries), _STEP):
            found, sim = self._search(queries[a : a + _STEP], beam, entries)
            out.append(found)
            sims.append(sim)
        return np.concatenate(out) if out else np.empty((0, beam), np.int32), np.concatenate(sims) if sims else np.empty((0, beam), np.float32)

    def _search(self, q: np.ndarray, beam: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(q), len(self.x)
        first = q @ self.x[entries].T
        k = min(beam // 2, len(entries))
        start = np.argpartition(-first, k - 1, axis=1)[:, :k]
        nodes = np.full((n, beam), none, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        todo = np.zeros((n, beam), bool)  # in the beam, not looked around yet
        nodes[:, :k], sims[:, :k], todo[:, :k] = entries[start], np.take_along_axis(first, start, 1), True
        seen = np.zeros((n, none + 1), bool)
        seen[np.arange(n)[:, None], nodes[:, :k]] = True
        seen[:, none] = True
        live = np.arange(n)
        while True:
            score = np.where(todo[live], sims[live], -3)
            pick = np.argpartition(-score, _ROUND - 1, axis=1)[:, :_ROUND]
            value = np.take_along_axis(score, pick, 1)
            open_ = value.max(1) > -3
            live, pick, value = live[open_], pick[open_], value[open_]
            if not len(live):
                break
            at = live[:, None]
            todo[at, pick] = False
            around = np.where(value > -3, nodes[at, pick], none)
            next_ = self.near[np.minimum(around, none - 1)]
            next_ = np.where((around[:, :, None] < none) & (next_ >= 0), next_, none).reshape(len(live), -1)
            row, column = np.nonzero(~seen[at, next_])
            node = next_[row, column]
            seen[live[row], node] = True
            sim = np.einsum("ij,ij->i", self.x[node], q[live[row]])
            better = sim > sims[live].min(1)[row]
            _, once = np.unique(row[better] * np.int64(none) + node[better], return_index=True)  # two nodes can have one neighbour
            row, node, sim = row[better][once], node[better][once], sim[better][once]
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(live))
            place = beam + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            width = beam + count.max()
            all_nodes, all_sims, all_todo = np.full((len(live), width), none, np.int32), np.full((len(live), width), -2, np.float32), np.zeros((len(live), width), bool)
            all_nodes[:, :beam], all_sims[:, :beam], all_todo[:, :beam] = nodes[live], sims[live], todo[live]
            all_nodes[row, place], all_sims[row, place], all_todo[row, place] = node, sim, True
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[live], sims[live], todo[live] = np.take_along_axis(all_nodes, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_todo, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        nodes = np.take_along_axis(nodes, order, 1)
        return np.where(nodes == none, -1, nodes), np.take_along_axis(sims, order, 1)


def fit(x: np.ndarray, total: int, count: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` unit landmarks of a sample of ``total`` rows, and the number of the shard of each, from 0.

    Landmarks are joined to shards of about ``most`` rows, nearest landmarks together.
    """
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32), np.zeros(1, np.int64)
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(6):
        nearest_ = (x @ c.T).argmax(1)
        sums = np.zeros((len(c), x.shape[1]))
        np.add.at(sums, nearest_, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
    load = np.bincount((x @ c.T).argmax(1), minlength=len(c)) * (total / len(x))
    shards, free, number = np.full(len(c), -1), np.ones(len(c), bool), 0
    sims = c @ c.T
    while free.any():
        head = np.flatnonzero(free)[load[free].argmax()]
        size = 0.0
        for k in np.argsort(-sims[head], kind="stable"):
            if free[k] and (size == 0 or size + load[k] <= most):
                shards[k], free[k], size = number, False, size + load[k]
            if size >= most:
                break
        number += 1
    return c, shards


def _nearest_shards(x: np.ndarray, marks: np.ndarray, shards: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, score): the shards of each row's ``probes`` nearest landmarks, each once, with the cosine to the landmark."""
    rows, to, scores = [], [], []
    k = min(probes, len(marks))
    for a in range(0, len(x), 4_096):
        sims = x[a : a + 4_096] @ marks.T
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        score = np.take_along_axis(sims, top, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        shard, score = shards[np.take_along_axis(top, order, 1)], np.take_along_axis(score, order, 1)
        once = np.ones(shard.shape, bool)
        for j in range(1, k):
            once[:, j] = ~(shard[:, :j] == shard[:, j : j + 1]).any(1)
        row, rank = np.nonzero(once)
        rows.append(row + a)
        to.append(shard[row, rank])
        scores.append(score[row, rank].astype(np.float64))
    return tuple(np.concatenate(v) if v else np.empty(0, kind) for v, kind in ((rows, np.int64), (to, np.int64), (scores, float)))


@dataclass(frozen=True)
class Shards:
    """Landmarks in levels: those of all rows, and per further level those of the shards it splits.

    The shards below shard s are numbered s * LANDMARKS + 1 and on; all lie below shard 0.
    """

    width: int
    marks: np.ndarray
    numbers: np.ndarray
    levels: list[dict[int, tuple[np.ndarray, np.ndarray]]]

    def size(self) -> int:
        """How many landmarks there are."""
        return len(self.marks) + sum(len(marks) for level in self.levels for marks, _ in level.values())

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, score), by row and best first: ``probes`` shards at most that are near each row.

        Until the last level more ways are followed than that: which shard is near shows by its finest
        landmarks only.
        """
        ways = max(probes, WAYS) if self.levels else probes
        row, shard, score = _nearest_shards(x, self.marks, self.numbers, ways)
        shard = shard + 1
        for level in self.levels:
            order = np.argsort(shard, kind="stable")
            at, start = np.unique(shard[order], return_index=True)
            parts, split = [], np.zeros(len(row), bool)
            for s, a, b in zip(at.tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
                if s in level:
                    some = order[a:b]
                    split[some] = True
                    mine, below, likeness = _nearest_shards(x[row[some]], *level[s], 2 * probes)
                    parts.append((row[some][mine], s * LANDMARKS + 1 + below, likeness))
            parts.append((row[~split], shard[~split], score[~split]))
            row, shard, score = (np.concatenate(v) for v in zip(*parts, strict=True))
            row, shard, score = _best(row, shard, score, ways)
        return _best(row, shard, score, probes)

    def route(self, rows: DataFrame, probes: int) -> DataFrame:
        """(rep, vec, shard, score): each row (rep, vec) with ``probes`` shards at most that are near it; a row's shards follow each other."""
        sent = rows.sparkSession.sparkContext.broadcast(self)  # about MOST_MARKS vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    row, shard, score = sent.value.nearest(matrix(batch.column(1), sent.value.width), probes)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(shard, pa.int64()), pa.array(score)], ["rep", "vec", "shard", "score"])

        return rows.select("rep", "vec").mapInArrow(run, "rep long, vec binary, shard long, score double")


def _best(row: np.ndarray, shard: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each row, best first."""
    order = np.lexsort((shard, -score, row))
    row, shard, score = row[order], shard[order], score[order]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < most
    return row[keep], shard[keep], score[keep]


def make_shards(reps: DataFrame, width: int) -> tuple[Shards, DataFrame, DataFrame]:
    """Shards fitted to the rows, the rows in them (rep, vec, shard), and the shards' sizes (shard, n)."""
    total = reps.count()
    fine = max(1, SHARD // MARKS_A_SHARD)
    several = total > LANDMARKS * fine  # one level would have too few landmarks to tell near shards from others
    count = max(2, min(LANDMARKS, total // (4 * SHARD))) if several else LANDMARKS
    share = min(1.0, 1.5 * SAMPLE / max(1, total))
    drawn = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) <= share * 1_000_003).limit(2 * SAMPLE).select("vec").collect()  # bounded by 2 * SAMPLE rows
    # With further levels each landmark of the first is a shard by itself, which they split.
    shards = Shards(width, *fit(matrix([bytes(r.vec) for r in drawn], width), total, count, 0 if several else SHARD), [])

    def model(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        marks, numbers = fit(matrix(rows.sort_values("rep")["vec"].tolist(), width), n, max(2, min(LANDMARKS, n // fine)), SHARD)
        return pd.DataFrame({"shard": [key[0]], "marks": [marks.tobytes()], "numbers": [numbers.astype(np.int64).tobytes()]})

    for number in range(MOST_LEVELS):
        rows = cut(shards.route(reps, 1).select("rep", "vec", "shard"))
        sizes = cut(rows.groupBy("shard").agg(F.count("*").alias("n")))  # a row per shard
        large = sizes.where(F.col("n") > (2 * fine if several and number == 0 else 2 * SHARD))
        if number == MOST_LEVELS - 1 or shards.size() >= MOST_MARKS or large.isEmpty():
            break
        some = rows.join(large, "shard").where(F.pmod(F.xxhash64("rep", F.lit(31)), F.lit(1_000_003)) <= F.least(F.lit(1.0), SAMPLE / F.col("n")) * 1_000_003)
        made = some.select("shard", "n", "rep", "vec").groupBy("shard").applyInPandas(model, "shard long, marks binary, numbers binary")
        # At most LANDMARKS vectors a shard, or one per ``fine`` rows; levels end at MOST_MARKS.
        shards.levels.append({r.shard: (np.frombuffer(bytes(r.marks), np.float32).reshape(-1, width), np.frombuffer(bytes(r.numbers), np.int64)) for r in made.toLocalIterator()})
    return shards, rows, sizes


def build_index(reps: DataFrame, width: int) -> tuple[Shards, DataFrame, DataFrame]:
    """The shards, the index (shard, part, node, rep, vec, near), a graph per part of a shard, and the parts (shard, parts)."""
    shards, home, sizes = make_shards(reps, width)
    sizes = sizes.select("shard", F.ceil(F.col("n") / (2 * SHARD)).cast("int").alias("parts"))
    placed = home.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), "parts").cast("int"))

    def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.random.default_rng(11).permutation(len(rows))] if len(rows) else rows
        made = Graph(matrix(rows["vec"].tolist(), width))
        return pd.DataFrame({"shard": key[0], "part": key[1], "node": np.arange(len(rows), dtype=np.int32), "rep": rows["rep"].to_numpy(), "vec": rows["vec"].to_numpy(), "near": [r.tobytes() for r in made.near]})

    spread = placed.select("shard", "part", "rep", "vec").repartition(task_count(reps.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", "rep")
    return shards, cut(spread.groupBy("shard", "part").applyInPandas(graph, "shard long, part int, node int, rep long, vec binary, near binary")), sizes


def send(queries: DataFrame, shards: Shards, parts: DataFrame, probes: int = PROBES) -> DataFrame:
    """(rep, shard, part, vec): each query (rep, vec) with the parts of shards it looks through.

    Shards whose landmark is much less like the query than the best one's are left out.
    """
    sent = shards.route(queries, probes)
    if probes > 1:

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rep, score = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
                if len(rep):
                    start = np.flatnonzero(np.append(True, rep[1:] != rep[:-1]))
                    top = np.repeat(np.maximum.reduceat(score, start), np.diff(np.append(start, len(rep))))
                    yield batch.filter(pa.array(score >= top - MARGIN))

        sent = sent.mapInArrow(near, "rep long, vec binary, shard long, score double")
    return sent.join(parts, "shard").select("rep", "shard", "vec", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def query_index(index: DataFrame, sent: DataFrame, width: int, k: int) -> DataFrame:
    """(rep, other, cosine): up to ``k`` + 1 found per query sent and part, the query itself left out."""
    load = sent.groupBy("shard", "part").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("blocks"))
    load = cut(load)  # a row per part
    sent = sent.join(load, ["shard", "part"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(9)), "blocks").cast("int")).select("shard", "part", "block", "rep", "vec")
    copies = index.join(load, ["shard", "part"]).select("shard", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "rep", "vec", "near")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "other": [], "cosine": []})
        right = right.sort_values("node")
        graph = Graph(matrix(right["vec"].tolist(), width), np.frombuffer(b"".join(right["near"]), np.int32).reshape(len(right), DEGREE))
        names = right["rep"].to_numpy()
        mine = left["rep"].to_numpy()
        asked = matrix(left["vec"].tolist(), width)
        nodes = graph.search(asked, max(QUERY_BEAM, 4 * k))[0][:, : k + 1]
        row, at = np.nonzero(nodes >= 0)
        other = names[nodes[row, at]]
        keep = other != mine[row]
        exact = [np.einsum("ij,ij->i", asked[row[a : a + 50_000]].astype(np.float64), graph.x[nodes[row[a : a + 50_000], at[a : a + 50_000]]].astype(np.float64)) for a in range(0, len(row), 50_000)]
        return pd.DataFrame({"rep": mine[row][keep], "other": other[keep], "cosine": np.concatenate(exact or [np.empty(0)])[keep]})

    tasks = task_count(index.sparkSession)
    keys = ["shard", "part", "block"]
    return sent.repartition(tasks, *keys).groupBy(*keys).cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(look, "rep long, other long, cosine double")


def nearest(vectors: DataFrame, k: int = 5, width: int = 64, queries: DataFrame | None = None, probes: int = PROBES) -> DataFrame:
    """(vec_id, other_id, cosine, place): the ``k`` most similar other vectors of every query, best first.

    ``vectors`` and ``queries`` as ``vectors.usable`` gives them; without ``queries`` all vectors ask.
    Equal cosines go to the smaller id; exact copies of a vector are its most similar ones.  Approximate:
    tests measure a recall of 0.9 at least against brute force.  No vectors, no rows.
    """
    with scratch(vectors.sparkSession) as keep:
        members, reps = folded(vectors)
        members, reps = cut(members), cut(reps)
        shards, index, parts = build_index(reps, width)
        asked = reps if queries is None else reps.join(members.join(queries.select("vec_id"), "vec_id", "left_semi").select("rep").distinct(), "rep", "left_semi")
        found = query_index(index, send(asked, shards, parts, probes), width, k)
        best = Window.partitionBy("rep").orderBy(F.desc("cosine"), F.asc("other"))
        found = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("rep", "other", "cosine"))
        # Copies: of every class the k + 1 smallest ids can be among anybody's best.
        within = Window.partitionBy("rep").orderBy("vec_id")
        few = members.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= k + 1)
        ask = members if queries is None else members.join(queries.select("vec_id"), "vec_id", "left_semi")
        several = few.groupBy("rep").agg(F.max("nth").alias("c")).where("c > 1").select("rep")
        offers = found.select("rep", "other", "cosine").unionByName(several.selectExpr("rep", "rep as other", "1.0D as cosine"))
        offers = offers.join(few.select(F.col("rep").alias("other"), F.col("vec_id").alias("other_id")), "other")
        mine = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), F.asc("other_id"))
        named = ask.join(offers, "rep").where("vec_id <> other_id").withColumn("place", F.row_number().over(mine)).where(F.col("place") <= k)
        return keep(named.select("vec_id", "other_id", "cosine", "place"))


def close_pairs(found: DataFrame, least: float = 0.8) -> DataFrame:
    """(vec_id_1, vec_id_2), smaller first: pairs of cosine ``least`` or more of which one is among the best of the other."""
    return found.where(F.col("cosine") >= least).select(F.least("vec_id", "other_id").alias("vec_id_1"), F.greatest("vec_id", "other_id").alias("vec_id_2")).distinct()
