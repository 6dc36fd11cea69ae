"""Near-duplicate records with small edits: exact set-similarity join, filtered under several token orders.

A record is the set of its word shingles.  Two records of Jaccard similarity t or more must share a
token among the first ones (the prefix) under *any* global order of tokens.  The rarest-first order
proposes candidates by a join on prefix tokens; in the same pass sizes, positions and a bitmap of
each set bound the overlap from above.  What is left must also share prefix tokens under further
orders (bands of rarity, shuffled differently in each), and only then are the sets compared.

Orders need to be the same everywhere, not exact: frequencies are those of the frequent tokens, of which
there is a bounded number, and all others count as rare.  Every filter is a necessary condition, so no
pair is lost; no bucket or posting list is capped.  Records with equal sets are one class throughout;
copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.entities import unescape
from docloom.llm.components import components
from docloom.session import cut, scratch, task_count

#: 64-bit words of the bitmap of each set, a multiple of eight.
MAP_WORDS = 16
#: Postings of a part (about), and pairs looked at side by side.
PART_POSTINGS, PAIRS_AT_ONCE = 500_000, 100_000
#: Orders asked after the rarest-first one; tokens whose frequency is known at most.
FURTHER_ORDERS, FREQUENT = (2, 3), 400_000
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class NearDuplicates:
    """What a join found: members (doc_id, cls) and links between classes (cls_1 < cls_2, similarity)."""

    members: DataFrame
    links: DataFrame


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(unescape(text)), F.lit(WORD), 0)


def _sets(docs: DataFrame, id_column: str, text: Column, width: int, least_words: int) -> DataFrame:
    """(doc_id, s, n, k1, k2): sorted distinct 64-bit shingle numbers, how many, and two hashes of the set, a key of 128 bits."""
    words = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.transform(_words(text), lambda w: F.xxhash64(w)).alias("w")).where(F.col("doc_id").isNotNull() & (F.size("w") >= max(least_words, width)))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, _, sizes = _tokens(batch.column(1))
            h = numbers.view(np.uint64)
            mixed = np.zeros(max(0, len(h) - width + 1), np.uint64)
            for k in range(width):
                mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(mixed)]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
            ends = np.cumsum(sizes)
            sets = [np.unique(mixed[end - size : end - width + 1]) for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
            n = np.array([len(s) for s in sets], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n)], ["doc_id", "s", "n"])

    return words.mapInArrow(shingles, "doc_id long, s array<long>, n int").selectExpr("doc_id", "s", "n", "xxhash64(s) as k1", "xxhash64(s, 7L) as k2")


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a column of sets, the row of each, and the rows' sizes."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), sizes


def frequencies(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and how often they occur: FREQUENT at most.

    Every task counts all its tokens and reports those that make up a fair part of its share, so a count
    may miss tasks where the token is rare; what travels is bounded by FREQUENT a task.
    """
    tasks = max(1, sets.rdd.getNumPartitions())
    least = max(2, -(-total // (FREQUENT * tasks)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            t, n = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            both, at = np.unique(np.concatenate([known, t]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            waiting.append(_tokens(batch.column(0))[0])
            held += len(waiting[-1])
            if held > 4_000_000:
                (known, counts), waiting, held = fold(), [], 0
        known, counts = fold()
        yield pa.RecordBatch.from_arrays([pa.array(known[counts >= least]), pa.array(counts[counts >= least])], ["t", "n"])

    found = sets.select("s").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "t").limit(FREQUENT).orderBy("t").toArrow()  # at most FREQUENT rows
    return table["t"].to_numpy(), table["n"].to_numpy()


def _hash(tokens: np.ndarray, seed: int) -> np.ndarray:
    x = tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def prefixes(tokens: np.ndarray, row: np.ndarray, sizes: np.ndarray, known: tuple[np.ndarray, np.ndarray], order: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and 32-bit number of the prefix tokens of some sets (2**16 at most) under an order.

    The first order is by frequency, the others by its logarithm; ties are in the order of a hash.  Rank and
    number make up a token's place in the order, so tokens that share both are one, to a pair's advantage.
    """
    frequent, counts = known
    at = np.searchsorted(frequent, tokens).clip(max=max(0, len(frequent) - 1))
    often = np.where(frequent[at] == tokens, counts[at], 0) if len(frequent) else np.zeros(len(tokens), np.int64)
    rank = np.minimum(often, 65_535) if order == 1 else np.log2(np.maximum(often, 1)).astype(np.int64)
    key = np.sort(row.astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64) << np.uint64(32) | _hash(tokens, order))
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < (sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)[row]  # rows keep their order
    return row[keep], place[keep], (key[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


_PREFIX = "cls long, n int, p array<int>, map binary"
_PART = "part int, one int, other int, second boolean, cls long, n int, j array<int>, t array<int>, map binary"


def _first(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Records (cls, s) with their prefix under the first order and a bitmap of the set."""
    for batch in batches:
        tokens, row, sizes = _tokens(batch.column(1))
        at, _, number = prefixes(tokens, row, sizes, known, 1, threshold)
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(sizes))))
        maps = np.zeros((len(sizes), MAP_WORDS), np.uint64)
        bits = tokens.view(np.uint64)
        np.bitwise_or.at(maps, (row, (bits % np.uint64(MAP_WORDS)).astype(np.int64)), np.uint64(1) << ((bits >> np.uint64(12)) & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number)), pa.array([m.tobytes() for m in maps], pa.binary())], ["cls", "n", "p", "map"])


def _spread(batches: Iterator[pa.RecordBatch], parts: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each record's prefix tokens with their places, a row per record and part.

    A part in ``hot`` is cut into that many blocks of records, and every two blocks meet in a group of
    their own (``one`` <= ``other``); ``second`` marks the records of the other block.
    """
    names = ["part", "one", "other", "second", "cls", "n", "j", "t", "map"]
    for batch in batches:
        t, row, sizes = _tokens(batch.column(2))
        if not len(t):
            continue
        place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * parts + (t % parts)
        order = np.argsort(key, kind="stable")
        at, start = np.unique(key[order], return_index=True)
        ends = pa.array(np.append(start, len(t)).astype(np.int32))
        taken = batch.take(pa.array(at // parts))
        part = (at % parts).astype(np.int32)
        blocks = np.array([hot.get(p, 1) for p in part.tolist()]) if hot else np.ones(len(part), np.int64)
        mine = ((taken.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
        again = np.repeat(np.arange(len(part)), blocks)
        met = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = mine[again]
        rows = pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(t[order])), taken.column(3)], names[4:])
        if len(again) > len(part):
            rows = rows.take(pa.array(again))
        columns = [pa.array(part[again]), pa.array(np.minimum(mine, met).astype(np.int32)), pa.array(np.maximum(mine, met).astype(np.int32)), pa.array(mine > met), *rows.columns]
        yield pa.RecordBatch.from_arrays(columns, names)


def _differences(maps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows ``a`` and ``b`` of bitmaps of eight words differ."""
    out = np.empty(len(a), np.int64)
    low = np.uint64(0x00FF00FF00FF00FF)
    for start in range(0, len(a), 32_768):  # what stays in the processor's cache
        bits = np.take(maps, a[start : start + 32_768], axis=0)
        bits ^= np.take(maps, b[start : start + 32_768], axis=0)
        count = np.bitwise_count(bits).view(np.uint64)[:, 0]  # eight bytes, summed at once
        out[start : start + 32_768] = ((count & low) + ((count >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)
    return out


def _farthest(size: np.ndarray, left: np.ndarray, threshold: float) -> np.ndarray:
    """The largest size of a set that can match sets of some sizes of which ``left`` tokens at most are shared."""
    return np.minimum(np.minimum(size / threshold, left * ((1 + threshold) / threshold) - size) + 1e-6, 2**31).astype(np.int64)


def _candidates(rows: pa.Table, threshold: float) -> pa.Table:
    """Pairs (smaller record, larger record) of one part that share a prefix token and pass the bounds.

    The smaller record's index prefix meets the larger one's probe prefix.  Under a token records are
    sorted by size, so that only sizes within the threshold are met; then places, then bitmaps bound
    the overlap.
    """
    rows = rows.combine_chunks()
    share = threshold / (1 + threshold)
    cls, n = rows["cls"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
    maps = np.frombuffer(b"".join(rows["map"].to_pylist()), np.uint64).reshape(len(cls), MAP_WORDS)
    halves = [np.ascontiguousarray(maps[:, k : k + 8]) for k in range(0, MAP_WORDS, 8)]
    lists = rows["t"].chunk(0) if rows["t"].num_chunks else None
    none = pa.table({"xc": pa.array([], pa.int64()), "yc": pa.array([], pa.int64())})
    if lists is None or not len(lists):
        return none
    row = np.repeat(np.arange(len(cls), dtype=np.int32), lists.value_lengths().to_numpy())
    t, j = lists.flatten().to_numpy(), rows["j"].chunk(0).flatten().to_numpy().astype(np.int64)
    size = n[row]
    order = np.lexsort((cls[row], size, t))
    row, t, j, size = row[order], t[order], j[order], size[order]
    second = rows["second"].to_numpy()[row]
    apart = rows["one"][0].as_py() != rows["other"][0].as_py()  # two blocks: only pairs across them
    left = (size - j).astype(np.int32)  # an upper bound of the overlap from here on
    last = np.searchsorted(t, t, side="right")
    # Of a token's records, those after x in the order of size, up to the largest that can match.
    far = _farthest(size, left, threshold)
    width = int(size.max()) + 2
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    upto = np.minimum(last, np.searchsorted(rank * width + size, rank * width + np.minimum(far, width - 1), side="right"))
    index = j < size - np.ceil(2 * share * size - 1e-9).astype(np.int64) + 1
    x = np.flatnonzero(index & (upto > np.arange(len(t)) + 1))
    counts = upto[x] - x - 1
    found: list[np.ndarray] = []
    small = size.astype(np.int32)
    ends = np.cumsum(counts)
    at = 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        some, many = x[at:stop], counts[at:stop]
        one = np.repeat(some, many)
        other = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + one + 1
        keep = np.minimum(left[one], left[other]) >= share * (small[one] + small[other]) - 1e-9
        if apart:
            keep &= second[one] != second[other]
        a, b = row[one[keep]], row[other[keep]]
        differ = np.zeros(len(a), np.int64)
        for half in halves:  # what differs too much in the first words need not be looked at further
            differ += _differences(half, a, b)
            keep = differ <= (1 - 2 * share) * (n[a] + n[b]) + 1e-9
            a, b, differ = a[keep], b[keep], differ[keep]
        found.append(np.unique(a.astype(np.int64) * len(cls) + b))
        at = stop
    pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pa.table({"xc": cls[pair // len(cls)], "yc": cls[pair % len(cls)]})


def _verified(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidates (xc, yc, xs, ys) that share prefix tokens under the further orders too and are as like as the threshold."""

    def shared(x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
        """How many of the keys (row << 32 | number) of both sides are equal, by row."""
        return np.bincount((np.intersect1d(x, y) >> np.uint64(32)).astype(np.int64), minlength=rows)

    keys = lambda row, number: row.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
    for batch in batches:
        for start in range(0, batch.num_rows, 4_000):
            some = batch.slice(start, 4_000)
            for order in FURTHER_ORDERS:
                sides = [prefixes(*_tokens(some.column(k)), known, order, threshold) for k in (2, 3)]
                held = shared(*(keys(row, number.view(np.uint32)) for row, _, number in sides), some.num_rows)
                some = some.filter(pa.array(held > 0))
            (xt, xr, xn), (yt, yr, yn) = (_tokens(some.column(k)) for k in (2, 3))
            number = np.unique(np.concatenate([xt, yt]), return_inverse=True)[1]  # exact: numbers stand for whole tokens
            both = shared(keys(xr, number[: len(xt)]), keys(yr, number[len(xt) :]), some.num_rows)
            keep = both >= threshold / (1 + threshold) * (xn + yn) - 1e-9
            x, y = (some.column(k).to_numpy(zero_copy_only=False)[keep] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(both[keep] / (xn + yn - both)[keep])], ["cls_1", "cls_2", "similarity"])


def near_duplicates(docs: DataFrame, id_column: str, text: Column, width: int = 5, threshold: float = 0.8, least_words: int = 0) -> NearDuplicates:
    """Classes of equal records and the links between different classes at ``threshold`` or more.

    Null text counts as empty; records of fewer words than ``width`` or ``least_words`` and null ids
    take no part.  Repeated rows count once; of different texts under one id the one of smallest hash is
    taken.  Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    with scratch(docs.sparkSession) as keep:
        sets = cut(_sets(docs, id_column, text, width, least_words))
        one = sets.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
        classes = one.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"))
        members = keep(one.join(classes, ["k1", "k2"]).select("doc_id", "cls", "k1", "k2"))
        first = members.where("doc_id = cls").select("doc_id", "k1", "k2")
        reps = sets.join(first, ["doc_id", "k1", "k2"], "left_semi").select(F.col("doc_id").alias("cls"), "s", "n")
        total, rows = reps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if rows > first.count():  # rows that repeat whole
            reps = reps.dropDuplicates(["cls"])
        reps = cut(reps)
        known = frequencies(reps, total)
        sent = docs.sparkSession.sparkContext.broadcast(known)  # at most FREQUENT tokens

        made = cut(reps.select("cls", "s").mapInArrow(lambda batches: _first(batches, sent.value, threshold), _PREFIX))
        # Postings go to parts by token.  A record sends a part all its tokens there in one row, so that its
        # bitmap travels once per part and not once per token.
        postings = made.agg(F.coalesce(F.sum(F.size("p")), F.lit(0))).first()[0]
        parts = max(1, -(-postings // PART_POSTINGS))
        # A part that a frequent token makes too large is cut into blocks of records.
        load = made.select(F.explode("p").alias("t")).groupBy(F.pmod("t", F.lit(parts)).cast("int").alias("part")).agg(F.count("*").alias("c")).where(F.col("c") > 4 * PART_POSTINGS)
        hot = {r.part: -(-r.c // (2 * PART_POSTINGS)) for r in load.collect()}  # fewer than postings / (4 * PART_POSTINGS) numbers
        spread = made.mapInArrow(lambda batches: _spread(batches, parts, hot), _PART)
        keys = ["part", "one", "other"]
        tasks = max(1, min(parts + sum(b * b for b in hot.values()), task_count(docs.sparkSession)))
        found = spread.repartition(tasks, *keys).groupBy(*keys).applyInArrow(lambda rows: _candidates(rows, threshold), "xc long, yc long")
        candidates = cut(found.distinct())

        side = lambda end, s: reps.select(F.col("cls").alias(end), F.col("s").alias(s))
        both = candidates.join(side("xc", "xs"), "xc").join(side("yc", "ys"), "yc").select("xc", "yc", "xs", "ys")
        links = keep(both.mapInArrow(lambda batches: _verified(batches, sent.value, threshold), "cls_1 long, cls_2 long, similarity double"))
    return NearDuplicates(members.select("doc_id", "cls"), links)


def pairs(near: NearDuplicates) -> DataFrame:
    """(document_id_1, document_id_2), smaller first: all pairs of documents, copies included.  As long as its result."""
    m = near.members
    a, b = m.select(F.col("cls").alias("cls_1"), F.col("doc_id").alias("x")), m.select(F.col("cls").alias("cls_2"), F.col("doc_id").alias("y"))
    linked = near.links.select("cls_1", "cls_2").join(a, "cls_1").join(b, "cls_2").select("x", "y")
    several = m.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls")
    copies = m.join(several, "cls", "left_semi")
    equal = copies.select("cls", F.col("doc_id").alias("x")).join(copies.select("cls", F.col("doc_id").alias("y")), "cls").where("x < y").select("x", "y")
    return linked.unionByName(equal).select(F.least("x", "y").alias("document_id_1"), F.greatest("x", "y").alias("document_id_2"))


def groups(near: NearDuplicates) -> DataFrame:
    """(document_id, group_id, copies, links): one row per document.

    ``group_id`` is the smallest document linked directly or through others, ``copies`` how many other
    documents have the same set, ``links`` how many different documents are linked directly.
    """
    m = near.members
    sizes = m.groupBy("cls").agg(F.count("*").alias("c"))
    ends = near.links.selectExpr("cls_1 as cls", "cls_2 as other").unionByName(near.links.selectExpr("cls_2 as cls", "cls_1 as other"))
    direct = ends.join(sizes.selectExpr("cls as other", "c"), "other").groupBy("cls").agg(F.sum("c").alias("links"))
    tied = components(near.links, "cls_1", "cls_2").select(F.col("vertex").alias("cls"), "group_id")
    per = sizes.join(direct, "cls", "left").join(tied, "cls", "left").selectExpr("cls", "coalesce(group_id, cls) as group_id", "c - 1 as copies", "coalesce(links, 0L) as links")
    return m.join(per, "cls").selectExpr("doc_id as document_id", "group_id", "copies", "links")
