"""The queries over the core operators: name -> function of (spark, folder), and the SQL each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import abbreviations, diff, encode, vectorize
from docloom.functions import text as X
from docloom.operators import analysis, density, events, frames, graph, nested, relate, similarity
from docloom.plans import fixtures, pipeline
from docloom.plans.sql import SQL
from docloom.session import cut, shared_dir, task_count
from docloom.sources import documents as sources
from docloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(name: str):
    return F.round(name, 6).alias(name)


# Nested records.
@query
def p6_found(spark, folder):
    return nested.node_table(table(spark, folder, "procedure_raw")).select("raw_id", "node_address", "parent_address")


@query
def p6_nodes(spark, folder):
    return nested.node_table(table(spark, folder, "procedure_raw"))


@query
def p6_links_in_sections(spark, folder):
    """Links at any depth below top-level sections, found by interval containment of two type tables."""
    tables = nested.type_tables(cut(nested.node_table(table(spark, folder, "procedure_raw"))))  # every body is parsed once
    return nested.contained(tables["sections"], tables["links"])


# Near-duplicate pairs by TF-IDF.
def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")


def _tfidf_pairs(spark, folder, top=None):
    docs = _docs(spark, folder)
    return docs, similarity.row_pairs(vectorize.tfidf_rows(docs, "doc_id", "text", ("lang",))[0], "doc_id", 0.45, ("lang",), top=top)


@query
def dup_pairs_tfidf(spark, folder):
    return _tfidf_pairs(spark, folder)[1].select("lang", "i", "j", r6("similarity"))


@query
def dup_pairs_labelled(spark, folder):
    docs, found = _tfidf_pairs(spark, folder, 500)
    pairs = similarity.candidate_pairs(found, docs, "doc_id", {"text": "text"}, 500, "lang")
    h = X.heuristic_relationship(F.col("item1_text"), F.col("item2_text"), F.col("similarity"))
    return pairs.select("cluster_label", "same_cluster", "item1_id", "item2_id", "similarity", h["type"].alias("relationship"), h["analysis"].alias("analysis"))


@query
def tfidf_vocab(spark, folder):
    docs = _docs(spark, folder)
    return vectorize.vocabulary(vectorize.term_frequencies(docs, "doc_id", F.col("text")), docs.count())


@query
def tfidf_vocab_bigrams(spark, folder, max_features=50_000):
    docs = _docs(spark, folder)
    tf = vectorize.term_frequencies(docs, "doc_id", F.col("text"), stop_words=vectorize.STOP_WORDS, bigrams=True)
    return vectorize.vocabulary(tf, docs.count(), max_features=max_features)


@query
def tfidf_weights(spark, folder):
    return vectorize.tfidf(_docs(spark, folder), "doc_id", "text").select("doc_id", "term", r6("weight"))


@query
def emb_pairs_within(spark, folder):
    return similarity.dense_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.3, ("label",)).select("label", "i", "j", r6("similarity"))


@query
def emb_pairs_all(spark, folder):
    return similarity.dense_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.4).select("i", "j", r6("similarity"))


@query
def exact_dups(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.md5(X.normalized("text").cast("binary")).alias("k"))
    groups = docs.groupBy("k").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(groups, "k").select("doc_id", "group_id", "copies")


# Documents and pairs.
@query
def cluster_type_counts(spark, folder):
    return analysis.type_counts(table(spark, folder, "procedure_documents"))


@query
def run_summary(spark, folder):
    pairs = table(spark, folder, "duplicate_pairs")
    return analysis.run_summary(table(spark, folder, "procedure_documents"), pairs, pairs, pairs.where("cross_encoder_passed"), similarity_threshold=0.45)


@query
def path_parts(spark, folder):
    return table(spark, folder, "procedure_documents").select("document_id", X.type_of_path("path").alias("type_of_path"), X.path_stem("path").alias("stem"))


@query
def title_chain(spark, folder):
    """First filled of title, path stem and a constant, as one row per document."""
    return table(spark, folder, "procedure_documents").select("document_id", F.coalesce(F.nullif(X.compact("title"), F.lit("")), F.nullif(X.path_stem("path"), F.lit("")), F.lit("untitled")).alias("title"))


@query
def clean_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.clean_text("text").alias("text"))


@query
def documents_of_bodies(spark, folder):
    return sources.documents_from_bodies(table(spark, folder, "procedure_raw"))


@query
def pair_endpoints(spark, folder):
    docs = table(spark, folder, "procedure_documents")
    side = lambda k: docs.select(F.col("document_id").alias(f"item{k}_id"), F.col("title").alias(f"item{k}_title"), F.col("document_type").alias(f"item{k}_doc_type"))
    return table(spark, folder, "duplicate_pairs").join(side(1), "item1_id").join(side(2), "item2_id").select("pair_id", "item1_id", "item2_id", "item1_title", "item2_title", "item1_doc_type", "item2_doc_type")


@query
def rerank_skip(spark, folder):
    pairs = table(spark, folder, "duplicate_pairs").select("pair_id", "item1_id", "item2_id", "similarity").where("similarity is not null and not isnan(similarity)")
    return relate.rerank(pairs, None, 0.95).select("pair_id", r6("cross_encoder_similarity_value"), "cross_encoder_passed")


@query
def passed_pairs(spark, folder):
    pairs = relate.of_types(table(spark, folder, "duplicate_pairs"), ["task", "activity"])
    return relate.above(pairs, "cross_encoder_similarity_value", 0.5, strict=True).select("pair_id", "item1_type", "cross_encoder_similarity_value")


@query
def top_pairs(spark, folder):
    pairs = table(spark, folder, "duplicate_pairs").where("similarity is not null and not isnan(similarity) and cross_encoder_similarity_value is not null and not isnan(cross_encoder_similarity_value)").select("item1_id", "item2_id", "similarity", "cross_encoder_similarity_value").distinct()
    return relate.reranked_order(pairs).limit(100)


@query
def unordered_pairs(spark, folder):
    pairs = table(spark, folder, "duplicate_pairs").where("item1_id is not null and item2_id is not null")
    return pairs.groupBy(F.least("item1_id", "item2_id").alias("a"), F.greatest("item1_id", "item2_id").alias("b")).agg(F.count("*").alias("n"))


@query
def label_status(spark, folder, top=500):
    """Labels of TF-IDF pairs without a model: heuristics, and why no model was asked."""
    docs, found = _tfidf_pairs(spark, folder, top)
    pairs = similarity.candidate_pairs(found, docs, "doc_id", {"text": "text"}, top)
    return relate.label(pairs).select("item1_id", "item2_id", "heuristic_relationship_type", "llm_relationship_type", "llm_analysis")


@query
def model_texts(spark, folder, length=2_500):
    return table(spark, folder, "procedure_documents").select("document_id", F.col("title").alias("item1_title"), F.col("summary").alias("item1_summary"), F.col("text").alias("item1_text")).select("document_id", relate.model_text(1, length).alias("model_text"))


@query
def pipeline_final(spark, folder):
    docs = table(spark, folder, "procedure_documents").select("document_id", "path", "document_type", "title", "summary", "text")
    return pipeline.find_duplicates(docs).final.select("cluster_label", "item1_id", "item2_id", r6("similarity"), "heuristic_relationship_type", "llm_relationship_type")


@query
def pipeline_from_bodies(spark, folder):
    """From JSON bodies to final pairs: documents, weights, clusters of their own, candidates, labels."""
    docs = sources.documents_from_bodies(table(spark, folder, "procedure_raw")).withColumnRenamed("raw_id", "document_id")
    return pipeline.find_duplicates(docs).final.select("cluster_label", "item1_id", "item2_id", r6("similarity"), "heuristic_relationship_type", "llm_relationship_type")


# Cluster statistics.
@query
def cluster_statistics(spark, folder):
    return analysis.cluster_statistics(table(spark, folder, "aggregated_vectors")).select("cluster_label", "num_verses", r6("avg_chapter"), r6("avg_verse_number"))


@query
def cluster_share_source(spark, folder):
    return analysis.shares(table(spark, folder, "aggregated_vectors"), "cluster_label", "source").select("cluster_label", "source", r6("percentage"))


@query
def cluster_share_chapter(spark, folder):
    return analysis.shares(table(spark, folder, "aggregated_vectors"), "cluster_label", "chapter").select("cluster_label", "chapter", r6("percentage"))


@query
def cluster_top_chapters(spark, folder):
    s = analysis.shares(table(spark, folder, "aggregated_vectors"), "cluster_label", "chapter").select("cluster_label", "chapter", r6("percentage"))
    return analysis.top_per_group(s, "cluster_label", "percentage", "chapter")


@query
def largest_clusters(spark, folder):
    return analysis.largest_clusters(analysis.cluster_statistics(table(spark, folder, "aggregated_vectors"))).select("cluster_label", "num_verses")


@query
def cohesion_by_label(spark, folder):
    return analysis.cohesion(table(spark, folder, "embeddings"), ("label",)).select("label", r6("average_pairwise_similarity"))


@query
def cohesion_by_chapter(spark, folder):
    return analysis.cohesion(table(spark, folder, "aggregated_vectors").where("chapter is not null"), ("chapter",)).select("chapter", r6("average_pairwise_similarity"))


@query
def cohesion_by_source_chapter(spark, folder):
    rows = table(spark, folder, "aggregated_vectors").where("chapter is not null and source is not null")
    return analysis.cohesion(rows, ("source", "chapter")).select("source", "chapter", r6("average_pairwise_similarity"))


@query
def cohesion_top_chapters(spark, folder):
    found = cohesion_by_source_chapter(spark, folder)
    return analysis.top_per_group(found, "source", "average_pairwise_similarity", "chapter")


@query
def clusters_density(spark, folder):
    return density.density_clusters(table(spark, folder, "embeddings"), "vec_id", "embedding", min_size=15, min_samples=5, epsilon=0.05)


@query
def embedding_projection(spark, folder):
    return density.random_projection(table(spark, folder, "embeddings"), "vec_id", "embedding", 16, 64)


@query
def embedding_plane(spark, folder):
    return density.plane(table(spark, folder, "embeddings"), "vec_id", "embedding")


# The relationship graph.
def _links(spark, folder, level="title"):
    pairs = table(spark, folder, "llm_analyzed_duplicates")
    graph.require_columns(pairs)
    return graph.links(graph.labelled_pairs(pairs, level, "cross_encoder_similarity_value"))


def _filtered(spark, folder):
    """The filtered graph that layouts are made of, cut once."""
    every = cut(_links(spark, folder))
    made = graph.filter_graph(every, graph.node_totals(every))
    return cut(made.links), cut(made.totals), made


@query
def graph_links(spark, folder):
    return _links(spark, folder, "document_type").select("relationship", "source_node", "target_node", r6("weight"), "pair_count", r6("avg_weight"), r6("max_weight"))


@query
def graph_links_by_title(spark, folder):
    return _links(spark, folder).select("relationship", "source_node", "target_node", r6("weight"), "pair_count", "source_id", "target_id", "source_path", "target_path", "llm_analysis")


@query
def graph_nodes(spark, folder):
    return graph.node_totals(_links(spark, folder)).select("node", r6("total"))


@query
def graph_filtered(spark, folder):
    return _filtered(spark, folder)[0].select("relationship", "source_node", "target_node", r6("weight"), "pair_count")


@query
def graph_filtered_nodes(spark, folder):
    return _filtered(spark, folder)[1].select("node", r6("total"))


@query
def graph_counts(spark, folder):
    links, totals, made = _filtered(spark, folder)
    return graph.totals_line(links).select("links", "pairs", r6("weight"), F.lit(made.all_nodes).alias("all_nodes"), F.lit(made.all_links).alias("all_links"))


@query
def graph_summary(spark, folder):
    return graph.relationship_summary(_links(spark, folder)).select("relationship", "links", "pairs", r6("weight"))


@query
def graph_arcs(spark, folder):
    arcs = graph.arcs(_filtered(spark, folder)[1])
    return arcs.select("node", *[r6(c) for c in ("total", "share_of_largest", "start", "end", "mid")], F.round(graph.label_rotation(F.col("mid")), 5).alias("rotation"))


@query
def graph_ports(spark, folder):
    links, totals, _ = _filtered(spark, folder)
    return graph.ports(links, graph.arcs(totals)).select("relationship", "source_node", "target_node", "side", "node", r6("angle"))


@query
def graph_widths(spark, folder):
    return graph.widths(_filtered(spark, folder)[0]).select("relationship", "source_node", "target_node", r6("width"))


@query
def graph_curves(spark, folder):
    """The first, a middle and the last point of every chord."""
    links, totals, _ = _filtered(spark, folder)
    p = graph.ports(links, graph.arcs(totals))
    at = p.groupBy(*graph.KEYS).agg(F.max(F.when(F.col("side") == "source", F.col("angle"))).alias("a"), F.max(F.when(F.col("side") == "target", F.col("angle"))).alias("b"))
    c = at.withColumn("c", graph.chord(F.col("a"), F.col("b"), F.col("source_node") == F.col("target_node")))
    return c.select(*graph.KEYS, F.size("c").alias("points"), F.round(F.col("c")[0]["x"], 5).alias("x0"), F.round(F.col("c")[24]["x"], 5).alias("x24"), F.round(F.col("c")[24]["y"], 5).alias("y24"), F.round(F.element_at("c", -1)["y"], 5).alias("y1"))


@query
def graph_relationship_order(spark, folder):
    return graph.relationship_order(_links(spark, folder))


@query
def graph_visibility(spark, folder):
    return graph.visibility(_filtered(spark, folder)[0])


@query
def graph_diff_records(spark, folder):
    links, _, _ = _filtered(spark, folder)
    return graph.diff_records(links).select("id", "label", "relationship", r6("weight"), "pairCount", "sourceId", "targetId", "sourceTitle", "targetTitle", "sourceTruncated")


@query
def graph_search(spark, folder):
    links, _, _ = _filtered(spark, folder)
    return graph.search(graph.diff_records(links), " Partial ").select("id", "relationship")


@query
def node_level(spark, folder):
    pairs = table(spark, folder, "llm_analyzed_duplicates")
    return spark.range(1).select(F.lit(graph.node_level(pairs)).alias("level"), F.lit(graph.weight_column(pairs)).alias("weight"))


@query
def token_diffs(spark, folder):
    docs, found = _tfidf_pairs(spark, folder, 500)
    pairs = similarity.candidate_pairs(found, docs, "doc_id", {"text": "text"}, 500).repartition(task_count(spark))
    d = pairs.withColumn("d", diff.diff_column(F.col("item1_text"), F.col("item2_text")))
    ops = lambda side, op: F.size(F.filter(f"d.{side}", lambda t: t["op"] == op))
    return d.select("item1_id", "item2_id", ops("left", "same").alias("same"), ops("left", "delete").alias("deleted"), ops("right", "insert").alias("inserted"), "d.truncated")


# Text functions.
@query
def sentences(spark, folder):
    return X.sentences(table(spark, folder, "documents"), ["doc_id"], "text")


@query
def text_previews(spark, folder, length=20_000):
    c = X.clipped("text", length)
    return table(spark, folder, "documents").select("doc_id", X.preview("text").alias("preview"), X.html_lines("text").alias("html"), c["text"].alias("clipped"), c["truncated"].alias("truncated"))


@query
def relationship_names(spark, folder):
    pairs = table(spark, folder, "llm_analyzed_duplicates").select(X.relationship_name("llm_relationship_type").alias("relationship"), X.is_skipped("llm_relationship_type").alias("skipped"))
    return pairs.groupBy("relationship", "skipped").agg(F.count("*").alias("n"), F.min(X.relationship_rank("relationship")).alias("rank"))


@query
def sigmoids(spark, folder):
    return table(spark, folder, "duplicate_pairs").where("similarity is not null and not isnan(similarity)").groupBy("pair_id").agg(F.round(F.max(X.sigmoid("similarity")), 6).alias("sigmoid"))


@query
def props_json(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query
def verse_keys(spark, folder):
    return fixtures.table(spark, fixtures.VERSES, "id int, key string").withColumn("v", X.verse_key("key")).select("id", "v.book", "v.chapter", "v.verse_number")


@query
def model_replies(spark, folder):
    return fixtures.table(spark, fixtures.REPLIES, "id int, reply string").withColumn("r", X.model_reply("reply")).select("id", "r.relationship_type", "r.analysis")


@query
def acronym_defs(spark, folder):
    return abbreviations.definitions(fixtures.table(spark, fixtures.ACRONYMS, "id int, text string"), "id", "text")


@query
def acronym_expand(spark, folder):
    return fixtures.table(spark, fixtures.ACRONYMS, "id int, text string").withColumn("e", abbreviations.expand_column(F.col("text"))).select("id", "e.text")


@query
def number_words(spark, folder):
    return table(spark, folder, "aggregated_vectors").select("vec_id", abbreviations.digits_column(F.col("text")).alias("text"))


# Events in policy text.
def _policies(spark):
    return fixtures.table(spark, fixtures.POLICIES, "doc_id int, text string")


@query
def events_core(spark, folder):
    found = events.map_text(_policies(spark))
    return found.select("doc_id", "sentence_index", "event_type", "frame", "trigger", "trigger_start", "polarity", "modality", "penalty_code.code", "penalty_code.number", "agent", "evaluee")


@query
def events_conditions(spark, folder):
    return events.map_text(_policies(spark)).select("doc_id", "sentence_index", "rule_condition.*", "time_text")


@query
def events_frames(spark, folder):
    frames = fixtures.table(spark, fixtures.FRAMES, "name string, id long, elements array<string>, lexical_units array<string>")
    return events.map_text(_policies(spark), frames=frames).select("doc_id", "sentence_index", "frame_net.validationStatus", "frame_net.target.lexicalUnit", F.array_join(F.array_sort(F.map_keys("frame_elements")), ",").alias("elements"), F.array_join("frame_net.invalid", ",").alias("invalid"))


@query
def events_json(spark, folder):
    docs = _policies(spark)
    return events.mapping_documents(docs, events.clean_mapping(events.map_text(docs)))


@query
def highlight_segments(spark, folder):
    return events.highlights(events.map_text(_policies(spark)))


@query
def events_evidence(spark, folder):
    return events.evidence_rows(events.map_text(_policies(spark)))


@query
def events_in_documents(spark, folder):
    """Events over the whole documents table, by type and polarity."""
    return events.map_text(table(spark, folder, "documents")).groupBy("event_type", "polarity").agg(F.count("*").alias("n"), F.count("penalty_code").alias("with_code"))


@query
def condition_expressions(spark, folder):
    return fixtures.table(spark, fixtures.CONDITIONS, "id int, text string").withColumn("c", events.condition(F.col("text"))).select("id", "c.*")


@query
def events_roles(spark, folder):
    """Roles read off a dependency parse, and how each was found."""
    docs = fixtures.table(spark, [*enumerate(fixtures.PARSED)], "doc_id int, text string")
    found = events.map_text(docs, parser=fixtures.parser)
    return found.select("doc_id", "event_type", "agent", "evaluee", F.col("rule_condition.text").alias("condition"), "time_text", F.col("evidence.Agent.relation").alias("agent_relation"), F.col("evidence.Evaluee.relation").alias("evaluee_relation"), F.col("evidence.Condition.relation").alias("condition_relation"), F.col("evidence.Time.relation").alias("time_relation"))


@query
def frame_summaries(spark, folder):
    f = lambda rows, kind: fixtures.table(spark, rows, kind)
    made = frames.summaries(f(fixtures.DEFINITIONS, "name string, id long, definition string"), f(fixtures.ELEMENTS, "frame string, id long, name string, core_type string, definition string"), f(fixtures.UNITS, "frame string, name string").withColumnRenamed("name", "name"), f(fixtures.RELATIONS, "frame string, relation string"))
    listed = lambda c: F.array_join(c, "|")
    core = F.array_join(F.array_sort(F.transform(F.map_entries("frame_elements"), lambda e: F.concat_ws(":", e["key"], e["value"]["core_type"], F.coalesce(e["value"]["definition"], F.lit(""))))), "|")
    return made.select("name", "id", "definition", core.alias("elements"), listed("lexical_units").alias("lexical_units"), listed("relations").alias("relations"))


@query
def frame_exemplars(spark, folder):
    return frames.exemplars(fixtures.table(spark, fixtures.EXAMPLES, "frame string, lexical_unit string, lexical_unit_id long, sentence_id long, text string")).select("frame", "lexical_unit", "sentence_id", "text", "place")


@query
def frame_exemplars_by_unit(spark, folder):
    return frames.exemplars(fixtures.table(spark, fixtures.EXAMPLES, "frame string, lexical_unit string, lexical_unit_id long, sentence_id long, text string"), by_unit=True).select("frame", "lexical_unit", "sentence_id", "text", "place")


@query
def encoded_texts(spark, folder):
    """Vectors of all texts by an injected encoder, a row per number that is not zero."""
    made = table(spark, folder, "documents").select("doc_id", encode.encode(F.col("text"), encode.letter_shares).alias("v"))
    return made.select("doc_id", F.posexplode("v").alias("place", "x")).where("x <> 0").select("doc_id", "place", F.round(F.col("x").cast("double"), 4).alias("x"))


# Sources and sinks, over files written from the tables.
def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, folder):
    """Pairs written as CSV and read again, required columns checked."""
    kept = table(spark, folder, "llm_analyzed_duplicates").select("item1_id", "item2_id", "item1_title", "item2_path", "llm_relationship_type", "llm_analysis")
    sinks.csv_folder(kept, path := _folder(spark, "csv"))
    back = sources.csv(spark, path, ("item1_id", "item2_id"), schema="item1_id long, item2_id long, item1_title string, item2_path string, llm_relationship_type string, llm_analysis string")
    return back.select("item1_id", "item2_id", *[F.coalesce(c, F.lit("")).alias(c) for c in back.columns[2:]])


@query
def verses_read(spark, folder):
    """Verse files of JSON, one per source, keys parsed to book, chapter and verse."""
    rows = table(spark, folder, "aggregated_vectors").where("source is not null and book is not null and chapter is not null and verse_number is not null and text is not null").where(F.col("book").rlike("^[a-zA-Z ]+$"))
    keyed = rows.groupBy("source", "book", "chapter", "verse_number").agg(F.min("text").alias("text"))
    entry = F.struct(F.concat_ws("", F.col("book"), F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse_number")).alias("key"), F.col("text").alias("value"))
    files = keyed.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))  # a file holds a source's own verses
    files.write.partitionBy("source").text(path := _folder(spark, "verses"))
    return sources.verse_files(spark, path).select("book", "chapter", "verse_number", "text")


@query
def zip_documents(spark, folder):
    """Documents of a zip of JSON files, one for every body that is a whole object."""
    import io
    import json
    import zipfile

    bodies = table(spark, folder, "procedure_raw").where("path is not null and body is not null")

    def pack(rows):
        import pandas as pd

        from docloom.operators.nested import whole_object

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for i, p, b in sorted(rows[["raw_id", "path", "body"]].itertuples(index=False)):
                if (record := whole_object(b)) is not None:
                    archive.writestr(f"zip/{p.replace(chr(92), '/').strip('/. ')}/{i}.json", json.dumps(record, ensure_ascii=False).encode("utf-8", "replace"))
        return pd.DataFrame({"content": [out.getvalue()]})

    packed = bodies.withColumn("_p", F.pmod(F.xxhash64("raw_id"), F.lit(8))).groupBy("_p").applyInPandas(pack, "content binary")
    path = _folder(spark, "zips")
    packed.write.parquet(path)
    return sources.zipped_documents(spark.read.parquet(path).select("content"))


@query
def uploads_read(spark, folder):
    """Every text sent as a file of one of the supported kinds, or an unsupported one."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "json", "pdf"))), F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1)
    content = F.when(kind == "json", F.to_json(F.struct(F.col("t").alias("text")))).otherwise(F.col("t"))
    requests = docs.select("doc_id", F.concat(F.lit("a."), kind).alias("filename"), F.lit(None).cast("string").alias("text"), F.base64(content.cast("binary")).alias("contentBase64"))
    return sources.uploads(requests).select("doc_id", F.length("document_text").alias("characters"), "error")
