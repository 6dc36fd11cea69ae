"""Labelled pairs as a weighted undirected graph: links, node totals, filters, and a circular layout.

All steps are relational.  Layout windows run over the filtered graph, which ``top_links`` and
``top_nodes`` bound; links and totals are plain aggregations with map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

REQUIRED = ("item1_path", "item2_path", "item1_type", "item2_type", "item1_title", "item2_title", "llm_relationship_type")
KEYS = ("relationship", "source_node", "target_node")
#: Relationships a viewer can have toggles for.
MOST_TOGGLES = 10_000
_SIDES = ("id", "path", "title", "summary", "text")


def require_columns(df: DataFrame, columns=REQUIRED) -> None:
    """Raises ValueError that lists the columns ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column(s): {', '.join(missing)}")


def optional_column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit("")


def weight_column(df: DataFrame, requested: str = "cross_encoder_similarity_value") -> str:
    """The first of the requested and the usual columns that holds any number."""
    there = [c for c in dict.fromkeys((requested, "cross_encoder_similarity_value", "similarity")) if c in df.columns]
    if there:
        number = lambda c: (n := F.col(c).cast("string").try_cast("double")).isNotNull() & ~F.isnan(n)
        found = df.agg(*[F.coalesce(F.bool_or(number(c)), F.lit(False)).alias(c) for c in there]).first()
        for c in there:
            if found[c]:
                return c
    raise ValueError("No usable numeric weight column found.")


def node_level(df: DataFrame, requested: str = "auto") -> str:
    """``auto``: document types where both sides together have two or more of them, else titles."""
    if requested != "auto":
        return requested
    types = [df.select(F.col(c).alias("t")) for c in ("item1_type", "item2_type") if c in df.columns]
    if not types:
        return "title"
    union = types[0] if len(types) == 1 else types[0].union(types[1])
    return "document_type" if union.where("t is not null").agg(F.count_distinct("t")).first()[0] >= 2 else "title"


def endpoint(side: int, level: str) -> Column:
    """The node a side of a pair belongs to; empty values fall back to 'document', or to the file's stem."""
    part = lambda name: F.trim(F.coalesce(F.col(f"item{side}_{name}"), F.lit("")))
    if level == "document_type":
        return F.coalesce(F.nullif(part("type"), F.lit("")), F.lit("document"))
    if level == "title":
        return F.coalesce(F.nullif(part("title"), F.lit("")), X.path_stem(part("path")))
    if level == "path":
        return part("path")
    raise ValueError(f"Unsupported node level: {level}")


def labelled_pairs(df: DataFrame, level: str, weight: str, include_unrelated: bool = False, label: str = "llm_relationship_type") -> DataFrame:
    """Pairs that count, with relationship, weight and both endpoints in node order.

    Out go skipped labels, weights that are no positive number, and unrelated pairs unless asked for.
    """
    number = F.col(weight).cast("string").try_cast("double")
    kept = df.where(~X.is_skipped(label)).withColumn("relationship", X.relationship_name(label)).withColumn("weight", number)
    kept = kept.where(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0))
    if not include_unrelated:
        kept = kept.where(F.col("relationship") != "Unrelated")
    kept = kept.withColumn("_n1", endpoint(1, level)).withColumn("_n2", endpoint(2, level))
    first = F.col("_n1") <= F.col("_n2")
    ends = []
    for name in _SIDES:
        one, two = optional_column(df, f"item1_{name}"), optional_column(df, f"item2_{name}")
        ends += [F.when(first, one).otherwise(two).alias(f"source_{name}"), F.when(first, two).otherwise(one).alias(f"target_{name}")]
    return kept.select("relationship", F.least("_n1", "_n2").alias("source_node"), F.greatest("_n1", "_n2").alias("target_node"), "weight", *ends, optional_column(df, "llm_analysis").alias("llm_analysis"))


def links(pairs: DataFrame) -> DataFrame:
    """A row per relationship and node pair: weight, pair_count, avg_weight, max_weight and an example.

    Example columns hold, each on its own, the value of the heaviest pair that has one; ties go to the
    smallest ids.
    """
    columns = [*(f"{side}_{n}" for n in _SIDES for side in ("source", "target")), "llm_analysis"]
    tie = F.struct("weight", F.struct(*[-F.coalesce(F.col(f"{s}_id").try_cast("long"), F.lit(0)) for s in ("source", "target")]), F.coalesce("source_path", F.lit("")), F.coalesce("target_path", F.lit("")))
    best = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), tie)).alias(c) for c in columns]
    rows = pairs.groupBy(*KEYS).agg(F.sum("weight").alias("weight"), F.count("*").alias("pair_count"), F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), *best)
    return rows.withColumn("example", F.concat(F.coalesce("source_path", F.lit("")), F.lit(" | "), F.coalesce("target_path", F.lit(""))))


def node_totals(links_: DataFrame) -> DataFrame:
    """(node, total): the weight of a node's links; a loop counts once."""
    ends = links_.select(F.col("source_node").alias("node"), "weight").unionAll(links_.where("source_node <> target_node").select(F.col("target_node").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("total"))


@dataclass(frozen=True)
class Filtered:
    """A filtered graph with its links, node totals and the counts before filtering."""

    links: DataFrame
    totals: DataFrame
    all_nodes: int
    all_links: int


def filter_graph(links_: DataFrame, totals: DataFrame, top_nodes: int = 64, top_links: int = 450, min_weight: float = 0.0) -> Filtered:
    """The heaviest nodes, links of ``min_weight`` between them, the heaviest of those; then totals anew.

    0 or less for a top means all.  ``all_nodes`` is counted before, ``all_links`` between the two tops.
    """
    all_nodes = totals.count()
    kept = links_
    if 0 < top_nodes < all_nodes:
        nodes = totals.orderBy(F.desc("total"), "node").limit(top_nodes).select("node")
        for end in ("source_node", "target_node"):
            kept = kept.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    if min_weight > 0:
        kept = kept.where(F.col("weight") >= min_weight)
    all_links = kept.count()
    if 0 < top_links < all_links:
        kept = kept.orderBy(F.desc("weight"), *KEYS).limit(top_links)
    return Filtered(kept, node_totals(kept).where("total > 0"), all_nodes, all_links)


def arcs(totals: DataFrame) -> DataFrame:
    """(node, total, share_of_largest, start, end, mid): every node's arc, clockwise from the top in name order."""
    every = Window.partitionBy()
    n = F.count("*").over(every)
    gap = F.radians(F.greatest(F.lit(1.2), F.least(F.lit(4.0), 90.0 / F.greatest(n, F.lit(1)))))
    grand = F.sum("total").over(every)
    span = (2 * pi - gap * n) * F.when(grand != 0, F.col("total") / grand).otherwise(1 / n)
    measured = totals.select("node", "total", span.alias("span"), gap.alias("gap"), (F.col("total") / F.max("total").over(every)).alias("share_of_largest"))
    before = F.coalesce(F.sum(F.col("span") + F.col("gap")).over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = measured.withColumn("start", F.lit(pi / 2) - before)
    return placed.select("node", "total", "share_of_largest", "start", (F.col("start") - F.col("span")).alias("end"), (F.col("start") - F.col("span") / 2).alias("mid"))


def ports(links_: DataFrame, arcs_: DataFrame) -> DataFrame:
    """(relationship, source_node, target_node, side, node, angle): where each link leaves each of its arcs.

    Ports of an arc stand in the order of the other end's angle, relationship, weight (heaviest first)
    and side, each as wide as its share of the weight, with gaps between.
    """
    sides = links_.select(*KEYS, "weight", F.expr("stack(2, 'source', source_node, target_node, 'target', target_node, source_node) as (side, node, other)"))
    joined = sides.join(arcs_.select("node", "start", "end"), "node").join(arcs_.select(F.col("node").alias("other"), F.col("mid").alias("other_angle")), "other")
    whole = Window.partitionBy("node")
    order = whole.orderBy("other_angle", X.relationship_rank("relationship"), F.desc("weight"), "side", "relationship", "other")
    n, heavy = F.count("*").over(whole), F.sum("weight").over(whole)
    margin = F.when(n > 1, 0.10).otherwise(0.50)
    gap = F.least(F.lit(0.018), 0.18 / F.greatest(n - 1, F.lit(1)))
    usable = F.greatest(F.lit(0.18), 1.0 - margin * 2 - gap * F.greatest(n - 1, F.lit(0)))
    share = usable * F.when(heavy != 0, F.col("weight") / heavy).otherwise(1 / n)
    spaced = joined.select(*KEYS, "weight", "side", "node", "start", "end", "other_angle", "other", share.alias("span"), gap.alias("gap"), margin.alias("margin"))
    before = F.coalesce(F.sum(F.col("span") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("margin") + before + F.col("span") / 2))
    return spaced.select(*KEYS, "side", "node", (F.col("start") + (F.col("end") - F.col("start")) * at).alias("angle"))


def widths(links_: DataFrame, least: float = 1.0, most: float = 18.0) -> DataFrame:
    """Links with ``width``: the root of the weight, scaled; one width if all weigh about the same."""
    every, root = Window.partitionBy(), F.sqrt("weight")
    lo, hi = F.min(root).over(every), F.max(root).over(every)
    same = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return links_.select(*KEYS, "weight", F.when(same, F.lit(max(least + 2, 4.0))).otherwise(least + (root - lo) / (hi - lo) * (most - least)).alias("width"))


def _curve(p: list[tuple[Column, Column]], steps: int) -> Column:
    """The points of a cubic curve as an array of struct(x, y)."""

    def at(k: Column) -> Column:
        t = k / (steps - 1)
        u = 1 - t
        axis = lambda n: u * u * u * p[0][n] + 3 * u * u * t * p[1][n] + 3 * u * t * t * p[2][n] + t * t * t * p[3][n]
        return F.struct(axis(0).alias("x"), axis(1).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)


def chord(source_angle: Column, target_angle: Column, loop: Column) -> Column:
    """The curve between two angles of the circle: 48 points, for a loop 54 that bulge outward."""
    point = lambda a, r=1.0: (F.cos(a) * r, F.sin(a) * r)
    straight = _curve([point(source_angle), point(source_angle, 0.22), point(target_angle, 0.22), point(target_angle)], 48)
    mid = (source_angle + target_angle) / 2
    out, along = point(mid, 1.38), (-F.sin(mid) * 0.18, F.cos(mid) * 0.18)
    bulge = _curve([point(source_angle), (out[0] - along[0], out[1] - along[1]), (out[0] + along[0], out[1] + along[1]), point(target_angle)], 54)
    return F.when(loop, bulge).otherwise(straight)


def arc_points(start: Column, end: Column, steps: int = 64, radius: float = 1.0) -> Column:
    step = lambda k: start + (end - start) * k / (steps - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct((F.cos(step(k)) * radius).alias("x"), (F.sin(step(k)) * radius).alias("y")))


def label_rotation(angle: Column) -> Column:
    """Degrees a label is turned by, never upside down."""
    d = F.degrees(angle)
    return F.when((d < -90) | (d > 90), d + 180).otherwise(d)


def relationship_summary(links_: DataFrame) -> DataFrame:
    """(relationship, links, pairs, weight), heaviest first."""
    return links_.groupBy("relationship").agg(F.count("*").alias("links"), F.sum("pair_count").alias("pairs"), F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "relationship")


def relationship_order(links_: DataFrame) -> DataFrame:
    """(position, relationship): the known relationships in their fixed order, then others by name."""
    names = links_.select("relationship").distinct()
    return names.select((F.row_number().over(Window.orderBy(X.relationship_rank("relationship"), "relationship")) - 1).alias("position"), "relationship")


def visibility(links_: DataFrame) -> DataFrame:
    """(toggle, relationship, source_node, target_node, visible): which links each toggle shows."""
    # Names may be free text of a model, so their list travels as one array and only if it is short.
    names = links_.select("relationship").distinct()
    if names.limit(MOST_TOGGLES + 1).count() > MOST_TOGGLES:
        raise ValueError(f"more than {MOST_TOGGLES} relationships to toggle")
    toggles = names.agg(F.array_sort(F.collect_set("relationship")).alias("toggles"))
    every = links_.join(F.broadcast(toggles)).select(*KEYS, F.explode("toggles").alias("toggle"))  # one row
    return every.select("toggle", *KEYS, (F.col("relationship") == F.col("toggle")).alias("visible"))


def totals_line(links_: DataFrame) -> DataFrame:
    return links_.agg(F.count("*").alias("links"), F.coalesce(F.sum("pair_count"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


def diff_records(links_: DataFrame) -> DataFrame:
    """A record per link, heaviest first, with both texts clipped: what a viewer needs to compare them."""
    order = Window.orderBy(F.desc("weight"), F.desc("avg_weight"), *KEYS)
    ranked = links_.select(*KEYS, "weight", "avg_weight").select(*KEYS, F.row_number().over(order).alias("_rank"))  # keys only: texts stay where they are
    links_ = links_.join(ranked, [*KEYS])
    a, b = X.clipped("source_text"), X.clipped("target_text")
    title = lambda side: F.coalesce(F.nullif(X.compact(f"{side}_title"), F.lit("")), F.col(f"{side}_node"))
    text = lambda c, name: X.json_text(c).alias(name)
    return links_.select(
        F.concat(F.lit("pair-"), F.col("_rank")).alias("id"),
        F.concat(title("source"), F.lit(" ↔ "), title("target")).alias("label"),
        text("relationship", "relationship"), F.col("weight"), F.col("avg_weight").alias("avgWeight"), F.col("pair_count").alias("pairCount"),
        text("source_node", "sourceNode"), text("target_node", "targetNode"), text("source_id", "sourceId"), text("target_id", "targetId"),
        text("source_path", "sourcePath"), text("target_path", "targetPath"), title("source").alias("sourceTitle"), title("target").alias("targetTitle"),
        text("source_summary", "sourceSummary"), text("target_summary", "targetSummary"), a["text"].alias("sourceText"), b["text"].alias("targetText"),
        a["truncated"].alias("sourceTruncated"), b["truncated"].alias("targetTruncated"), text("llm_analysis", "analysis"),
    )


def search(records: DataFrame, query: str) -> DataFrame:
    """Diff records in whose label, relationship, paths or summaries the query occurs, letter case aside."""
    hay = F.lower(F.concat_ws(" ", "label", "relationship", "sourcePath", "targetPath", "sourceSummary", "targetSummary"))
    return records.where(F.contains(hay, F.lit(query.strip().lower())))
