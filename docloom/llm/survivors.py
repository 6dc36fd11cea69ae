"""Best representative of each duplicate group: the surviving value of every field.

Members are ranked field by field: ``text`` by completeness (different words), ``modified`` by
recency, ``path`` by the trust in its root.  Ties go to the smallest id.  The ranks are windows of
which only the first row is kept; Spark limits each group within every task before the shuffle
(WindowGroupLimit), so a group of a third of all rows sends one row per task and field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.entities import unescape
from docloom.functions.moments import moment, path_root, utc

#: Above so many roots the table of roots is joined by the optimizer's choice, not broadcast by hint.
FEW_ROOTS = 10_000


def _members(groups: DataFrame) -> DataFrame:
    """Distinct (group_id, document_id) of groups with two members at least."""
    members = groups.select(F.col("group_id").cast("string"), F.col("document_id").cast("long")).where("group_id is not null and document_id is not null").distinct()
    several = members.groupBy("group_id").agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi")).where("lo < hi").select("group_id")
    return members.join(several, "group_id", "left_semi")


def _scored(docs: DataFrame, roots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, words, moment, trust, keep...): what each field's rank looks at; null where it takes no part."""
    kinds = dict(docs.dtypes)
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(unescape(F.col("text"))), F.lit(r"[\p{L}\p{N}]+"), 0)))
    when = moment(F.col("modified"))
    loaded = utc(F.col("loaded_at"), kinds["loaded_at"])
    first = F.lit("2000-01-01T00:00:00Z").cast("timestamp")
    rows = docs.where("document_id is not null").select(
        F.col("document_id").cast("long").alias("document_id"),
        F.when(words > 0, words.cast("long")).alias("words"),
        F.when(when.between(first, loaded), F.unix_micros(when)).alias("moment"),
        path_root(F.col("path")).alias("root"),
        *keep,
    )
    ranks = roots.where("root_name is not null").groupBy(F.lower(F.trim("root_name")).alias("root")).agg(F.min("trust_rank").cast("long").alias("trust"))
    if ranks.limit(FEW_ROOTS + 1).count() <= FEW_ROOTS:
        ranks = F.broadcast(ranks)
    last = F.lit(2**62)
    return rows.join(ranks, "root", "left").select("document_id", "words", "moment", F.when(F.col("root").isNotNull(), F.coalesce("trust", last)).alias("trust"), *keep)


def surviving_fields(docs: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(group_id, field_name, document_id): per group and field the member whose value survives.

    A field no member has a usable value for gives no row.  Null ids, groups of one, members without
    a document and repeated rows do no harm; repeated documents count with their best values.
    Nulls in other columns and extra columns are ignored; empty tables give no rows.
    """
    scores = _scored(docs, roots)
    joined = _members(groups).join(scores, "document_id")
    fields = joined.select("group_id", "document_id", F.expr("stack(3, 'text', words, 'modified', moment, 'path', -trust) as (field_name, score)")).where("score is not null")
    best = Window.partitionBy("group_id", "field_name").orderBy(F.desc("score"), F.asc("document_id"))
    return fields.withColumn("place", F.row_number().over(best)).where("place = 1").select("group_id", "field_name", "document_id")


def surviving_records(docs: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """One built record per group: (group_id, text, modified, path, text_from, modified_from, path_from).

    Values are the stored ones of the surviving members; a field without survivor is null.  Of rows that
    repeat a document the one that won gives the value (of equal ones the larger value).
    """
    chosen = surviving_fields(docs, groups, roots)
    asked = docs.join(chosen.select(F.col("document_id").alias("_asked")).distinct(), F.col("document_id").cast("long") == F.col("_asked"), "left_semi")
    won = lambda field, score: F.max_by(field, F.when(F.col(score).isNotNull(), F.struct(F.col(score) if score != "trust" else -F.col(score), F.col(field)))).alias(field)
    values = _scored(asked, roots, ("text", "modified", "path")).groupBy("document_id").agg(won("text", "words"), won("modified", "moment"), won("path", "trust"))
    got = chosen.join(values, "document_id").select("group_id", "field_name", "document_id", F.expr("case field_name when 'text' then text when 'modified' then modified else path end").alias("value"))
    pick = lambda what, field: F.max(F.when(F.col("field_name") == field, F.col(what)))
    return got.groupBy("group_id").agg(*[pick("value", f).alias(f) for f in ("text", "modified", "path")], *[pick("document_id", f).alias(f"{f}_from") for f in ("text", "modified", "path")])
