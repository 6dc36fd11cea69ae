"""Frames as lookup tables: their summaries, and examples of their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

#: Fixed value: what an example is called.
EXAMPLE = "FrameNet lexicographic exemplar"


def summaries(frames: DataFrame, elements: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, id, definition, frame_elements, lexical_units, relations): a row per frame.

    Takes (name, id, definition), (frame, id, name, core_type, definition), (frame, name) and (frame, relation).
    Definitions lose their markup; elements are a map by name, units are sorted, relations too.  Frames
    without elements, units or relations have empty ones.
    """
    body = F.struct("id", "name", "core_type", X.plain_definition("definition").alias("definition"))
    fe = elements.groupBy("frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), body.alias("value"))))).alias("frame_elements"))  # a frame's own elements
    listed = lambda rows, column, name: rows.groupBy("frame").agg(F.array_sort(F.collect_set(column)).alias(name))
    made = frames.select("name", "id", X.plain_definition("definition").alias("definition"))
    for part in (fe, listed(units, "name", "lexical_units"), listed(relations, "relation", "relations")):
        made = made.join(part.withColumnRenamed("frame", "name"), "name", "left")
    empty: Column = F.array().cast("array<string>")
    none = F.map_from_arrays(empty, F.array().cast("array<struct<id:bigint,name:string,core_type:string,definition:string>>"))
    return made.select("name", "id", "definition", F.coalesce("frame_elements", none).alias("frame_elements"), F.coalesce("lexical_units", empty).alias("lexical_units"), F.coalesce("relations", empty).alias("relations"))


def exemplars(examples: DataFrame, by_unit: bool = False, limit: int = 2) -> DataFrame:
    """(frame, lexical_unit, lexical_unit_id, sentence_id, text, source_type, place): the first examples of each frame, or of each of its units.

    Takes (frame, lexical_unit, lexical_unit_id, sentence_id, text); first are the smallest sentence ids.
    """
    order = Window.partitionBy("frame", *(["lexical_unit"] if by_unit else [])).orderBy("sentence_id", "lexical_unit_id")
    ranked = examples.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return ranked.select("frame", "lexical_unit", "lexical_unit_id", "sentence_id", X.strip(F.col("text")).alias("text"), F.lit(EXAMPLE).alias("source_type"), "place")
