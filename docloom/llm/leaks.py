"""Evaluation texts leaking into training text: prefix-filtered set join with exact containment.

A document leaks an item if it holds ``run`` consecutive words of the item in order, case,
punctuation, spacing and look-alike characters aside.  Such a window of ``run`` words is a set of
``run - shingle + 1`` shingles that the document must contain whole, so by the prefix filter it
must contain the window's rarest shingle.

1. One pass over the corpus notes, per document, the positions of shingles that occur in items.
2. Shingles are counted over all documents; each item window keeps its rarest one as prefix token.
3. Documents join windows on that token; the token's position fixes where the window would start,
   and the document's length bounds it.
4. The window is verified: all its shingles stand at their places.

A window of fewer words than ``run`` (a short item) never leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.skeleton import plain_words, word_tables
from docloom.session import cut, scratch

#: Item words up to which the items' dictionary is sent to the workers (about 100 bytes a word);
#: beyond it shingles travel by a shuffle join.
LOCAL_ITEM_WORDS = 500_000


class ShingleIndex:
    """Exact numbers for the items' shingles, looked up for many texts at once.

    A shingle's number comes from its words' numbers by folding pairs into ranks, so that equal
    numbers mean equal words; nothing is hashed.
    """

    def __init__(self, texts: list[list[str]], size: int):
        self.size = size
        self.vocabulary: dict[str, int] = {}
        for w in chain.from_iterable(texts):
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.width = len(self.vocabulary) + 1
        words, _ = self._flat(texts)
        valid = self._windows(words)
        self.levels: list[np.ndarray] = []
        prefix = words[: len(words) - size + 1].copy() if len(words) >= size else words[:0]
        for k in range(1, size):
            step = prefix * self.width + words[k : k + len(prefix)]
            self.levels.append(np.unique(step[valid]))
            prefix = np.searchsorted(self.levels[-1], step).clip(max=max(0, len(self.levels[-1]) - 1))

    def _flat(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocabulary.get
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter((get(w, -1) for t in texts for w in chain(t, (None,))), np.int64, int(lengths.sum()) + len(texts))
        return flat, lengths

    def _windows(self, words: np.ndarray) -> np.ndarray:
        """Whether all words from each position on, to the size of a shingle, are known ones."""
        n = max(0, len(words) - self.size + 1)
        known = words >= 0
        valid = np.ones(n, bool)
        for k in range(self.size):
            valid &= known[k : k + n]
        return valid

    def find(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, word position and shingle number of every known shingle."""
        words, lengths = self._flat(texts)
        at = np.flatnonzero(self._windows(words))
        code = words[at]
        for k, level in enumerate(self.levels, 1):
            step = code * self.width + words[at + k]
            code = np.searchsorted(level, step).clip(max=max(0, len(level) - 1))
            same = level[code] == step if len(level) else np.zeros(len(step), bool)
            at, code = at[same], code[same]
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.searchsorted(starts, at, side="right") - 1
        return text, at - starts[text], code


def _split(tables):
    """A text's words as a column, look-alikes aside."""

    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: plain_words(t, tables.value))

    return F.pandas_udf(words, "array<string>")


def _items(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    words = _split(word_tables(items.sparkSession))
    return items.select(F.col(id_column).cast("long").alias("item_id"), words(F.col(text_column)).alias("words")).where("item_id is not null").distinct()


def _positions_local(docs: DataFrame, index: ShingleIndex) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    tables = word_tables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = sent.value
        for batch in batches:
            texts = [plain_words(t, tables.value) for t in batch.column(1).to_pylist()]
            text, position, shingle = ours.find(texts)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.fromiter(map(len, texts), np.int32, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids[text], pa.int64()), pa.array(position.astype(np.int32)), pa.array(shingle.astype(np.int64)), pa.array(lengths[text])], ["doc_id", "position", "shingle", "n_words"])

    return docs.mapInArrow(run, "doc_id long, position int, shingle long, n_words int")


def _shingles(words: str, size: int) -> str:
    return f"posexplode(case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> array_join(slice({words}, i + 1, {size}), ' ')) else array() end) as (position, shingle)"


def item_windows(items: DataFrame, run: int = 13, size: int = 5, id_column: str = "item_id", text_column: str = "text"):
    """Items' words, with the shingles of each as (item, item_id, n_item, position, shingle text); an item is one text of an id."""
    words = cut(_items(items, id_column, text_column).withColumn("item", F.monotonically_increasing_id()))
    return words, words.where(F.size("words") >= run).selectExpr("item", "item_id", "size(words) as n_item", _shingles("words", size))


def leaks(docs: DataFrame, items: DataFrame, run: int = 13, size: int = 5, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", local_item_words: int = LOCAL_ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id): each document with ``run`` consecutive words of an item, once per item.

    Null and empty texts, on either side, leak nothing; rows with a null id are kept out; repeated
    rows count once, different texts under one item id each on their own; other columns are ignored.  Whole
    texts are read.
    """
    if not 1 <= size <= run:
        raise ValueError("need 1 <= size <= run")
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
        words, shingles = item_windows(items, run, size, item_id_column, item_text_column)
        total = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        if total <= local_item_words:
            held = words.where(F.size("words") >= run).orderBy("item").collect()  # bounded by local_item_words
            texts, ids = [r.words for r in held], [r.item_id for r in held]
            index = ShingleIndex(texts, size)
            text, position, shingle = index.find(texts)
            shingles = spark.createDataFrame(pd.DataFrame({"item": text.astype(np.int64), "item_id": np.array(ids, np.int64)[text], "n_item": np.array([len(t) for t in texts], np.int32)[text], "position": position.astype(np.int32), "shingle": shingle}) if texts else [], "item long, item_id long, n_item int, position int, shingle long")
            found = _positions_local(rows, index)
        else:
            spread = rows.select("doc_id", _split(word_tables(spark))("text").alias("words")).selectExpr("doc_id", "size(words) as n_words", _shingles("words", size))
            found = spread.join(shingles.select("shingle").distinct(), "shingle", "left_semi").select("doc_id", "position", "shingle", "n_words")
        found = cut(found.distinct())

        # Rarity over all documents; a shingle no document holds settles its windows at once.
        counts = found.groupBy("shingle").agg(F.count_distinct("doc_id").alias("in_documents"))
        per_window = run - size + 1
        windows = shingles.where(f"position <= n_item - {size}").join(counts, "shingle")
        windows = windows.selectExpr("item", "item_id", "n_item", "position", "shingle", "in_documents", f"explode(sequence(greatest(0, position - {per_window - 1}), least(position, n_item - {run}))) as first")
        windows = windows.groupBy("item", "item_id", "first").agg(F.min(F.struct("in_documents", "shingle", "position")).alias("rarest"), F.count("*").alias("held"), F.collect_list(F.struct("position", "shingle")).alias("content"))  # at most run - size + 1 entries
        windows = windows.where(f"held = {per_window}").selectExpr("item_id", "first", "rarest.shingle as shingle", "rarest.position - first as offset", "transform(array_sort(content), c -> c.shingle) as content")

        # Equal windows of several items are looked for once.
        content = cut(windows.groupBy("content", "shingle", "offset").agg(F.collect_set("item_id").alias("items")).withColumn("window", F.monotonically_increasing_id()))
        candidates = found.join(content.select("window", "shingle", "offset"), "shingle").where(f"position >= offset and position - offset + {run} <= n_words").selectExpr("doc_id", "window", "position - offset as start")
        wanted = content.selectExpr("window", "posexplode(content) as (k, shingle)")
        asked = candidates.distinct().join(wanted, "window").selectExpr("doc_id", "window", "start", "start + k as position", "shingle")
        whole = asked.join(found, ["doc_id", "position", "shingle"]).groupBy("doc_id", "window", "start").agg(F.count("*").alias("held")).where(f"held = {per_window}")
        return keep(whole.select("doc_id", "window").distinct().join(content.select("window", F.explode("items").alias("item_id")), "window").select("doc_id", "item_id").distinct())


def leak_report(found: DataFrame, items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """(item_id, documents): every item with the number of documents that leak it, 0 included."""
    every = items.select(F.col(id_column).cast("long").alias("item_id")).where("item_id is not null").distinct()
    return every.join(found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents")), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0).cast(T.LongType())).alias("documents"))
