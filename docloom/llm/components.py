"""Consolidating pairwise matches into groups by low-diameter decomposition.

Each round draws every vertex an exponential shift; clusters grow from the vertices that start
first (largest shift) along the edges, a vertex joining the cluster that reaches it first.  Grown
clusters contract to super-vertices, only edges between clusters stay, and the next round recurses
on those.  The assignments of all rounds, composed, name the component of every vertex.

A vertex always lies in one component with the centre it joined, whenever growth stops, so a fixed
number of hops per round is enough; edges shrink by a constant factor a round in expectation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, scratch

#: Rate of the exponential shifts: the smaller, the larger the clusters and the fewer the rounds.
RATE = 0.05
#: Hops a cluster grows in one round.
HOPS = 3
#: Members beyond which a component's name is broadcast.
GIANT = 1_000_000
#: Rounds after which the recursion is given up with an error; edges shrink geometrically, so it is never near.
MOST_ROUNDS = 60


def _shift(vertex: str, seed: int) -> str:
    """The vertex's shift in this round, drawn from 52 bits of a hash: repeatable on any executor, hardly ever a tie."""
    return f"(-ln((shiftrightunsigned(xxhash64({vertex}, {seed}L), 12) + 0.5D) / {2**52}D) / {RATE}D)"


def _grow(edges: DataFrame, seed: int) -> DataFrame:
    """(v, c): the cluster centre of every vertex of symmetric edges (a, b)."""
    best = F.max_by("c", "reach").alias("c"), F.max("reach").alias("reach")  # of fixed width, so that hashes aggregate and nothing is sorted
    state = edges.select(F.col("a").alias("v")).distinct().selectExpr("v", "v as c", f"{_shift('v', seed)} as reach")
    for hop in range(HOPS):
        if hop == 0:  # every vertex stands for itself yet: no join is needed
            offers = edges.selectExpr("b as v", "a as c", f"{_shift('a', seed)} - 1 as reach")
        else:
            offers = edges.join(state.withColumnRenamed("v", "a"), "a").selectExpr("b as v", "c", "reach - 1 as reach")
        state = state.unionByName(offers).groupBy("v").agg(*best)
    return state.select("v", "c")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(vertex, group_id): for each vertex of an edge between two different ones, the smallest vertex of its component.

    Both columns become bigint.  Edges may repeat and stand in either order; self pairs and edges with
    a null end tie nothing and are left out; other columns are ignored; no edges, no rows.
    """
    with scratch(edges.sparkSession) as keep:
        ends = edges.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).where("x <> y")
        # Copies of an edge fold before the shuffle.
        now = cut(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        maps: list[DataFrame] = []
        for seed in range(MOST_ROUNDS):
            if now.isEmpty():
                break
            both = now.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(now.select(F.col("y").alias("a"), F.col("x").alias("b")))
            joined = cut(_grow(both, seed))
            maps.append(joined)
            to = lambda end, name: joined.select(F.col("v").alias(end), F.col("c").alias(name))  # noqa: B023, E731
            moved = now.join(to("x", "p"), "x").join(to("y", "q"), "y").where("p <> q")
            now = cut(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
        else:
            raise RuntimeError("the decomposition did not end")
        if not maps:
            return keep(now.select(F.col("x").alias("vertex"), F.col("y").alias("group_id")))
        # Compose from the last round back: first every vertex gets the root of its component.
        final = maps[-1].select("v", F.col("c").alias("root"))
        for earlier in reversed(maps[:-1]):
            later = final.select(F.col("v").alias("c"), "root")
            final = earlier.join(later, "c", "left").select("v", F.coalesce("root", "c").alias("root"))
        # Then roots are renamed to the smallest vertex.  Those of giant components, of which there can be no more
        # than vertices divided by GIANT, are broadcast, so that no task has to take in all members of one.
        final = cut(final)
        least = cut(final.groupBy("root").agg(F.min("v").alias("group_id"), F.count("*").alias("members")))
        giant = F.broadcast(least.where(F.col("members") > GIANT).select("root", "group_id"))
        others = final.join(giant.select("root"), "root", "left_anti").join(least.where(F.col("members") <= GIANT).select("root", "group_id"), "root")
        return keep(final.join(giant, "root").unionByName(others).select(F.col("v").alias("vertex"), "group_id"))


def normal_label(label):
    """A relationship label in one spelling: small, trimmed, separators as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-‐-―]+", "_")


def matched_pairs(pairs: DataFrame, analysed: DataFrame, labels: tuple[str, ...] = ("semantically_identical", "one_doc_included")) -> DataFrame:
    """(a, b), a < b: pairs of different documents that ``pairs`` has and ``analysed`` labels as a match, in either order.

    One matching row is enough, whatever contradicting rows say.
    """
    ids = lambda df: df.select(F.least(F.col("item1_id").cast("long"), F.col("item2_id").cast("long")).alias("a"), F.greatest(F.col("item1_id").cast("long"), F.col("item2_id").cast("long")).alias("b"), F.col("item1_id").alias("l"), F.col("item2_id").alias("r")).where("l is not null and r is not null and a < b").select("a", "b")
    wanted = ids(analysed.where(normal_label(F.col("llm_relationship_type")).isin(*labels)))
    return ids(pairs).distinct().join(wanted.distinct(), ["a", "b"], "left_semi")


def match_groups(pairs: DataFrame, analysed: DataFrame) -> DataFrame:
    """(item_id, group_id): one row for each document with a match."""
    return components(matched_pairs(pairs, analysed)).select(F.col("vertex").alias("item_id"), "group_id")
