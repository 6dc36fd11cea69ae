"""The training-data queries: name -> function of (spark, folder), and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import clusters, components, language, leaks, mixing, near, proximity, skeleton, survivors, vectors
from docloom.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p9_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"))[1]


def p9_shares_at_corpus_size(spark: SparkSession, folder: str) -> DataFrame:
    """As much as the corpus holds: small sources run short, their siblings take over."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"), budget_share=1.0)[1]


def _domains(targets: DataFrame) -> dict[str, str]:
    """Each source's domain, the first word of its name; targets do not grow with the texts."""
    names = targets.select(mixing.normal_source(F.col("source")).alias("s")).where("s is not null").distinct().limit(mixing.MOST_LEAVES).collect()
    return {r.s: r.s.split("_")[0] for r in names}


def p9_shares_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """As much as the corpus holds, with domains: what a source lacks goes to its siblings before other domains."""
    targets = table(spark, folder, "mixture_targets")
    return mixing.mixture(table(spark, folder, "documents"), targets, budget_share=1.0, domains=_domains(targets))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, folder, "documents"))


def p10_groups(spark: SparkSession, folder: str) -> DataFrame:
    return skeleton.look_alike_groups(table(spark, folder, "documents"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.surviving_fields(*(table(spark, folder, t) for t in ("procedure_documents", "duplicate_groups", "path_roots")))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.surviving_records(*(table(spark, folder, t) for t in ("procedure_documents", "duplicate_groups", "path_roots")))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "procedure_documents")
    return language.languages(docs, language.fit_on(docs))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.corrections(p2_languages(spark, folder))


def _title_and_text():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


def _near(spark: SparkSession, folder: str) -> near.NearDuplicates:
    return near.near_duplicates(table(spark, folder, "procedure_documents"), "document_id", _title_and_text(), width=3, threshold=0.5, least_words=20)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.pairs(_near(spark, folder))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near.groups(_near(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.match_groups(table(spark, folder, "duplicate_pairs"), table(spark, folder, "llm_analyzed_duplicates"))


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.usable(table(spark, folder, "aggregated_vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.similarity_clusters(_usable(spark, folder))


def p4_described(spark: SparkSession, folder: str) -> DataFrame:
    found = _usable(spark, folder)
    return clusters.describe(found, clusters.similarity_clusters(found))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return proximity.close_pairs(proximity.nearest(_usable(spark, folder)))


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """A search: the rows whose id is divisible by 20 ask, against all rows."""
    found = _usable(spark, folder)
    return proximity.nearest(found, k=10, queries=found.where("vec_id % 20 = 0"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(p8_found(spark, folder), table(spark, folder, "eval_items"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_described": p4_described, "p5_found": p5_found, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_found": p8_found, "p8_report": p8_report, "p9_drawn": p9_drawn, "p9_shares": p9_shares, "p9_shares_at_corpus_size": p9_shares_at_corpus_size, "p9_shares_by_domain": p9_shares_by_domain, "p10_found": p10_found, "p10_groups": p10_groups}
__all__ = ["QUERIES", "SQL"]
