import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectorize
from docloom.operators import analysis, density, events, graph, relate, similarity
from docloom.plans import fixtures, pipeline
from docloom.session import cut


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        w = rng.random(30) * (rng.random(30) < 0.3)
        w = w / (np.linalg.norm(w) or 1)
        rows += [(i, ["a", "b", None][i % 3], f"t{k}", float(x)) for k, x in enumerate(w) if x]
    return spark.createDataFrame(rows, "id long, g string, term string, weight double")


def got(df):
    return {(r.i, r.j): round(r.similarity, 9) for r in df.collect()}


def test_kernels_agree(spark, sparse):
    full = got(similarity.inverted_pairs(sparse, "id", 0.3))
    assert len(full) > 20 and all(i < j for i, j in full)
    assert got(similarity.sparse_pairs(sparse, "id", 0.3)) == full
    assert got(similarity.sparse_pairs(sparse, "id", 0.3, block=7)) == full
    grouped = similarity.sparse_pairs(sparse, "id", 0.3, ("g",), block=5)
    assert got(grouped) == {p: s for p, s in full.items() if p[0] % 3 == p[1] % 3}
    dense = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m")).select("id", F.array(*[F.coalesce(F.col("m")[f"t{k}"], F.lit(0.0)) for k in range(30)]).alias("v"))
    assert got(similarity.pairs(dense, "id", 0.3, vector="v")) == full
    assert got(similarity.dense_pairs(dense.union(spark.createDataFrame([(99, None), (98, [0.0] * 30)], "id long, v array<double>")), "id", "v", 0.3, block=9)) == full
    with pytest.raises(ValueError):
        similarity.pairs(sparse, "id", 0.3, kernel="other")


def test_empty_pairs(spark, sparse):
    assert similarity.sparse_pairs(sparse.limit(0), "id", 0.3, ("g",)).count() == 0
    assert similarity.dense_pairs(spark.createDataFrame([], "id long, v array<float>"), "id", "v", 0.3).count() == 0


PAIRS = [
    ("p/b.json", "p/a.json", "task", "generic", "B", "A", "semantically_identical", "0.9", "n1"), ("p/a.json", "p/b.json", "generic", "task", "A", "B", "semantically_identical", " 0.5 ", "n2"),
    ("p/b.json", "p/a.json", "task", "generic", "B", "A", "semantically_identical", "0.95", None), ("p/a.json", "p/a.json", "task", "task", "A", "A", "parse_error", "1.0", None),
    ("p/c.json", "p/a.json", None, "task", "", "A", "conflict_in_information", "0.4", "x"), ("p/c.json", "p/a.json", "task", "task", "C", "A", "none_of_above", "0.4", "x"),
    ("p/c.json", "p/a.json", "task", "task", "C", "A", "SKIPPED_LIMIT", "0.4", "x"), ("p/c.json", "p/a.json", "task", "task", "C", "A", "one_doc_included", "n/a", "x"), ("p/c.json", "p/a.json", "task", "task", "C", "A", "one_doc_included", "0", "x"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(*r, k, k + 1, {}) for k, r in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "item1_path string, item2_path string, item1_type string, item2_type string, item1_title string, item2_title string, llm_relationship_type string, cross_encoder_similarity_value string, llm_analysis string, item1_id long, item2_id long, weight map<string,int>")


def test_links(labelled):
    graph.require_columns(labelled)
    with pytest.raises(ValueError, match="item1_path"):
        graph.require_columns(labelled.drop("item1_path"))
    assert graph.weight_column(labelled, "nothing") == "cross_encoder_similarity_value" and graph.node_level(labelled) == "document_type"
    links = graph.links(graph.labelled_pairs(labelled, "title", "cross_encoder_similarity_value"))
    rows = {(r.relationship, r.source_node, r.target_node): r for r in links.collect()}
    assert set(rows) == {("Duplicated", "A", "B"), ("parse_error", "A", "A"), ("Contradiction", "A", "c")}
    top = rows["Duplicated", "A", "B"]
    assert (round(top.weight, 6), top.pair_count, top.max_weight, top.source_path, top.llm_analysis) == (2.35, 3, 0.95, "p/a.json", "n1")
    totals = {r.node: round(r.total, 6) for r in graph.node_totals(links).collect()}
    assert totals == {"A": 3.75, "B": 2.35, "c": 0.4}
    kept = graph.filter_graph(links, graph.node_totals(links), 2, 1, 0.5)
    assert (kept.all_nodes, kept.all_links) == (3, 2) and kept.links.count() == 1
    arcs = graph.arcs(graph.node_totals(links)).orderBy("node").collect()
    gap = np.radians(4.0)
    assert abs(arcs[0].start - np.pi / 2) < 1e-12 and all(abs(a.end - gap - b.start) < 1e-9 for a, b in zip(arcs, arcs[1:]))
    ports = graph.ports(links, graph.arcs(graph.node_totals(links))).collect()
    inside = {a.node: (a.end, a.start) for a in arcs}
    assert len(ports) == 6 and all(inside[p.node][0] <= p.angle <= inside[p.node][1] for p in ports)
    assert {round(r.width, 6) for r in graph.widths(links.limit(1)).collect()} == {4.0}
    records = graph.diff_records(links)
    assert [r.id for r in records.orderBy("id").collect()] == ["pair-1", "pair-2", "pair-3"] and graph.search(records, "CONTRA").count() == 1


def test_cohesion_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 64)).astype(np.float32)
    rows = [(k % 3, x[k].tolist()) for k in range(20)] + [(7, x[0].tolist()), (7, [0.0] * 64), (8, None)]
    found = {r.g: r.average_pairwise_similarity for r in analysis.cohesion(spark.createDataFrame(rows, "g int, embedding array<float>"), ("g",)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(3):
        s = u[g::3] @ u[g::3].T
        assert abs(found[g] - s[np.triu_indices(len(s), 1)].mean()) < 1e-6
    assert found[7] == 0.0 and 8 not in found


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([np.eye(64)[k] + 0.02 * rng.standard_normal((30, 64)) for k in range(3)] + [rng.standard_normal((15, 64))])
    labels = density.density_labels(x)
    assert {*labels[:90].reshape(3, 30)[:, 0]} == {0, 1, 2} and all(len({*labels[k * 30 : k * 30 + 30]} - {-1}) == 1 for k in range(3))
    assert min((labels == k).sum() for k in range(labels.max() + 1)) >= 15
    assert (density.density_labels(x) == labels).all() and (density.density_labels(x[:90], epsilon=0.0) >= 0).all()
    assert (density.density_labels(x[:10]) == -1).all()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None)], "id int, v array<double>")
    assert {r.id: r.cluster_label for r in density.density_clusters(rows, "id", "v").collect()} == {**dict(enumerate(map(int, labels))), 1000: -1}


def test_rerank_and_labels(spark):
    rows = [(k, k + 1, 0.1 * k, "T", None, "text %d" % k, "U", "s", "other") for k in range(6)]
    pairs = spark.createDataFrame(rows, "item1_id int, item2_id int, similarity double, item1_title string, item1_summary string, item1_text string, item2_title string, item2_summary string, item2_text string")
    scored = relate.rerank(pairs, lambda a, b: [float(len(t)) - 8 for t in a], 0.5)
    assert all(abs(r.cross_encoder_similarity_value - 1 / (1 + np.exp(-(len("T\n\ntext 0") - 8)))) < 1e-9 for r in scored.collect())
    assert pairs.select(relate.model_text(2)).first()[0] == "U\n\ns\n\nother"

    def client(a, b):
        if a.endswith("3"):
            raise TimeoutError("late")
        return '{"relationship_type": "none_of_above", "analysis": "ok"}' if a.endswith("5") else "?"

    got = {r.item1_id: r.llm_relationship_type for r in relate.label(pairs, client, 3).collect()}
    assert got == {5: "none_of_above", 4: "parse_error", 3: "API_ERROR", 2: "SKIPPED_LIMIT", 1: "SKIPPED_LIMIT", 0: "SKIPPED_LIMIT"}
    assert {r.llm_relationship_type for r in relate.label(pairs).collect()} == {"SKIPPED_NO_API_KEY"}


@pytest.fixture(scope="module")
def found(spark):
    frames = spark.createDataFrame(fixtures.FRAMES, "name string, id long, elements array<string>, lexical_units array<string>")
    return events.map_text(spark.createDataFrame(fixtures.POLICIES, "doc_id int, text string"), frames=frames)


def test_events(found):
    rows = {(r.doc_id, r.sentence_index): r for r in found.collect()}
    first, second = rows[1, 0], rows[1, 1]
    assert (first.event_type, first.trigger, first.polarity, first.penalty_code.code, first.penalty_code.number, first.penalty_code.label, first.penalty_code.sanctionType) == ("PenaltyImposition", "is imposed", "positive", "D31", 31, "Late report - Second notice", "disqualification")
    assert (first.rule_condition.operator, first.rule_condition.right, first.rule_condition.unit) == ("lessThan", 420, "hour")
    assert first.sentence[first.trigger_start : first.trigger_end] == "is imposed"
    assert (second.event_type, second.trigger, second.penalty_code.code) == ("PenaltyTermination", "terminated", "D31") and second.sentence[second.trigger_start :].startswith("terminated on")
    assert second.rule_condition.text == "the evidence received supports that the disqualification be lifted" and second.time_text == "on the Monday of the week after the review week"
    assert (rows[2, 0].polarity, rows[2, 0].agent, rows[2, 0].penalty_code.code) == ("negative", "the agent", "D18")
    assert rows[3, 0].frame == "Activity_stop" and rows[3, 0].rule_condition.text == "the employer confirms the dates"
    assert (rows[4, 0].event_type, rows[4, 0].frame, rows[4, 0].frame_net.validationStatus, rows[4, 0].frame_elements) == ("PenaltyRescission", None, "domain_event_only", {})
    assert rows[4, 2].penalty_code.sanctionType == "penalty" and rows[4, 2].frame_net.target.lexicalUnit == "penalty.n"
    assert rows[5, 0].event_type == "PenaltySuspension" and rows[5, 0].penalty_code is None
    assert (rows[6, 0].rule_condition.lower, rows[6, 0].rule_condition.upper) == (1204, 1240) and rows[6, 0].polarity == "negative"
    assert (7, 0) not in rows and [rows[8, k].modality for k in (0, 1, 2)] == ["required", "prohibited", "asserted"] and rows[8, 2].penalty_code.code == "D33"
    assert first.frame_net.validationStatus == "validated_frame_no_exact_lu" and first.frame_elements["Evaluee"].text == "the claimant" and first.frame_elements["Agent"].implicit


def test_event_documents(spark, found):
    docs = spark.createDataFrame(fixtures.POLICIES, "doc_id int, text string")
    made = {r.doc_id: r for r in events.mapping_documents(docs, found).collect()}
    assert made[1].eventCount == 2 and made[7].eventCount == 0 and made[7].warnings == [events.NO_TRIGGER]
    segments = events.highlights(found).where("doc_id = 2").orderBy("segment").collect()
    assert "".join(s.text for s in segments) == fixtures.POLICIES[1][1] and [(s.type, s.text) for s in segments if s.type] == [("agent", "the agent"), ("trigger", "does not impose"), ("code", "D18"), ("evaluee", "the claimant")]
    plain = events.map_text(docs)
    bare = events.highlights(plain).where("doc_id = 2").orderBy("segment").collect()  # without registry an event has no elements
    assert [(s.type, s.text) for s in bare if s.type] == [("trigger", "does not impose"), ("code", "D18")]
    assert {r.frame_net.validationStatus for r in plain.collect()} == {"registry_unavailable", "domain_event_only"}
    assert events.map_text(docs.limit(0)).count() == 0


def test_parser_roles_win(spark):
    s = spark.createDataFrame([(1, 0, "The board suspends D1.", {"agent": ("The board", "active_subject", "suspends", 0, 9)})], "doc_id int, sentence_index int, sentence string, roles map<string,struct<text:string,relation:string,head:string,start:int,end:int>>")
    r = events.events(s, syntax="roles").first()
    assert r.agent == "The board" and r.evidence.Agent.method == "dependency_parse" and r.evidence.Time.method == "implicit_or_unresolved"


def test_pipeline(spark):
    text = "the officer copies every page of the claim file before noon"
    rows = [(k, f"a/task/{k}.json", "task", f"title {k % 2}", None, text + f" {'extra words here' if k == 3 else ''}", 0 if k < 4 else -1) for k in range(6)]
    rows += [(k, "a/b.json", "", "apart", "", f"wholly different matter number{k}", 5) for k in (6, 7)]
    docs = spark.createDataFrame(rows, "document_id int, path string, document_type string, title string, summary string, text string, cluster_label int")
    out = pipeline.find_duplicates(docs)
    assert {(r.item1_id, r.item2_id) for r in out.final.collect()} == {(0, 1), (0, 2), (1, 2), (4, 5), (0, 3), (1, 3), (2, 3), (6, 7)} and out.summary.first().document_count == 8
    assert pipeline.find_duplicates(docs, cluster=None).final.count() == 16 and pipeline.find_duplicates(docs.limit(0)).final.count() == 0


def test_spread_clusters_equal_those_of_one_task(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([c + 0.15 * rng.standard_normal((size, 12)) for c, size in zip(np.eye(12)[:4] * 2, (40, 30, 20, 6), strict=True)] + [rng.standard_normal((12, 12))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12)], "id long, v array<double>")
    want = {**dict(enumerate(map(int, density.density_labels(x)))), 1000: -1, 1001: -1, 1002: -1}
    assert {r.id: r.cluster_label for r in density.spread_clusters(rows, "id", "v", block=25).collect()} == want and len(set(want.values())) == 4


def test_pipeline_makes_clusters(spark):
    """Documents as they are read, without labels: two kinds of text and one without words."""
    rng = np.random.default_rng(4)
    words = [[f"{kind}word{k}" for k in range(12)] for kind in ("claim", "appeal")]
    rows = [(20 * g + k, f"a/task/{g}-{k}.json", "task", f"title {g}", None, " ".join([*words[g], *rng.choice(words[g], 6)])) for g in (0, 1) for k in range(20)] + [(99, "a/b.json", "", "apart", "", "")]
    docs = spark.createDataFrame(rows, "document_id int, path string, document_type string, title string, summary string, text string")
    out = pipeline.find_duplicates(docs, top_pairs=None)
    stats = {(r.cluster_label, r.document_type): r["count"] for r in out.cluster_stats.collect()}
    assert stats == {(0, "task"): 20, (1, "task"): 20, (-1, ""): 1} and out.summary.first().cluster_count == 3
    found = out.final.collect()
    assert found and all(r.same_cluster and r.cluster_label == r.item1_id // 20 == r.item2_id // 20 for r in found)
    assert pipeline.find_duplicates(docs.limit(0)).final.count() == 0


def test_roles_of_a_parse(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(fixtures.PARSED)] + [(9, fixtures.POLICIES[1][1]), (10, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in events.map_text(docs, parser=fixtures.parser).collect()}
    passive, active, rules = got[0], got[1], got[9]
    assert (passive.agent, passive.evaluee, passive.time_text) == ("the regional office", "The client's", "until Monday")
    assert (passive.evidence.Agent.method, passive.evidence.Agent.relation, passive.evidence.Time.relation) == ("dependency_parse", "passive_agent", "temporal_prep:until")
    assert (active.agent, active.rule_condition.text, active.evidence.Condition.relation) == ("the bureau", "the client calls back today", "conditional_advcl:unless")
    assert active.evaluee == "the client" and active.evidence.Evaluee.relation == "nsubj_linked_to_trigger" and active.evidence.Time.method == "implicit_or_unresolved"
    assert (rules.agent, rules.evidence.Agent.method) == ("the agent", "domain_rule")
    for sentence, tokens in zip(fixtures.PARSED, fixtures.parser([*fixtures.PARSED]), strict=True):
        assert all(sentence[t.start : t.end] == t.text for t in tokens)


def test_trigger_tokens():
    from docloom.operators.syntax import Token, roles, trigger_token

    tokens = [Token("It", 0, "it", "PRON", "nsubj", 1), Token("ran", 3, "run", "VERB", "ROOT", 1), Token("off", 7, "off", "ADP", "prt", 1)]
    assert trigger_token(tokens, 3, 6) == 1 and trigger_token(tokens, 7, 10) is None and roles("It ran off", tokens, 7, 10) == {}
    assert roles("It ran off", tokens, 3, 6)["agent"]["text"] == "It"
    loop = [Token("a", 0, "client", "NOUN", "dep", 1), Token("b", 2, "b", "NOUN", "dep", 0), Token("imposes", 4, "impose", "VERB", "ROOT", 2)]
    assert "evaluee" not in roles("a b imposes", loop, 4, 11)


def test_encoder(spark):
    from docloom.functions.encode import encode, letter_shares

    rows = spark.createDataFrame([(1, "abba"), (2, None), (3, "Zz!")], "id int, t string").select("id", encode(F.col("t"), letter_shares, 2).alias("v")).collect()
    got = {r.id: np.array(r.v) for r in rows}
    assert np.allclose(got[1][:3], [2**-0.5, 2**-0.5, 0]) and not got[2].any() and got[3][25] == 1 and len(got[2]) == 26


def test_large_groups_are_clustered_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(8)[:3], 30, axis=0) + 0.05 * rng.standard_normal((90, 8))
    rows = spark.createDataFrame([(k, [float(v) for v in r], k % 2) for k, r in enumerate(x)] + [(100, None, 0)], "id long, v array<double>, g int")
    alone = {r.id: r.cluster_label for r in density.density_clusters(rows, "id", "v", "g", min_size=10).collect()}
    monkeypatch.setattr(density, "MOST_ROWS", 20)
    assert {r.id: r.cluster_label for r in density.density_clusters(rows, "id", "v", "g", min_size=10).collect()} == alone and alone[100] == -1 and len(set(alone.values())) == 4


def test_core_distance_leaves_the_point_itself_out():
    """Five points in a row of growing gaps: with one sample the core distance is that to the nearest other point."""
    angles = np.array([0.0, 0.1, 0.3, 0.7, 1.5])
    x = np.column_stack([np.cos(angles), np.sin(angles)])
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    seen = {}
    original, density._tree = density._tree, lambda v, core: seen.update(core=core) or original(v, core)
    try:
        density.density_labels(x, min_size=2, min_samples=1, epsilon=0.0)
    finally:
        density._tree = original
    assert np.allclose(seen["core"], np.sort(d, axis=1)[:, 1])


def test_best_pairs_of_copies_need_no_blocks(spark, monkeypatch):
    """Where enough pairs of equal rows exist, the best pairs come without comparing blocks, and are those of the blocks."""
    rng = np.random.default_rng(3)
    made = []
    for i in range(400):
        own = np.random.default_rng(i % 300)  # a hundred rows have a copy
        terms = own.choice(60, 1 if i % 50 == 7 else 12, replace=False)
        w = own.random(len(terms)) + 0.1
        if i >= 390:
            w[0] *= 1 + 3e-4  # nearly a copy: rounds to 1 as well
        w /= np.sqrt((w * w).sum())
        made += [(int(i), ("a", "b", None)[i % 3], f"t{t}", float(x)) for t, x in zip(terms, w, strict=True)]
    rng.shuffle(made)
    rows = spark.createDataFrame(made, "id int, g string, term string, weight double")
    best = lambda df, n: [(r.g, r.i, r.j, round(r.similarity, 6)) for r in df.withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "i", "j").limit(n).collect()]
    named = lambda df: df if "g" in df.columns else df.withColumn("g", F.lit(0))
    want = [best(named(similarity.sparse_pairs(rows, "id", 0.3, group)), 60) for group in ((), ("g",))]
    monkeypatch.setattr(similarity, "_blocked", lambda *a: pytest.fail("blocks were compared"))
    assert [best(named(similarity.sparse_pairs(rows, "id", 0.3, group, top=60)), 60) for group in ((), ("g",))] == want


def test_rows_of_weights_equal_tfidf(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x", "aa bb aa cc"), (2, None, "bb cc dd"), (3, "x", "cc dd dd é1"), (4, "y", None), (5, "y", "zz"), (6, "x", "É1 bb ñandú ñandú")], "id int, g string, text string")
    twice = docs.union(spark.createDataFrame([(1, "x", "dd bb")], docs.schema))
    for d, most in ((docs, 1_000_000), (docs, 1), (twice, 1_000_000)):
        monkeypatch.setattr(vectorize, "MOST_TERMS", most)
        for how in ({"bigrams": True, "stop_words": ("cc",), "max_features": 3},):
            want = {(r.id, r.g, r.t): round(r.weight, 9) for r in vectorize.tfidf(d, "id", "text", ("g",), max_df=1.0, **how).select("id", "g", F.xxhash64("term").alias("t"), "weight").collect()}
            rows, vocab = vectorize.tfidf_rows(d, "id", "text", ("g",), max_df=1.0, **how)
            got = {(r.id, r.g, t): round(w, 9) for r in rows.collect() for t, w in zip(r._t, r._w, strict=True)}
            assert got == want and {k[2] for k in want} <= {r.t for r in vocab.collect()}


def test_cut_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = manager.shuffleStatuses().size()
    assert cut(spark.range(1_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert manager.shuffleStatuses().size() <= before + 1  # that of the count


def test_spread_clusters_send_few_copies_at_once(spark, monkeypatch):
    """Blocks that meet in several rounds give the clusters of one task, and no round takes all copies of the rows."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.2 * rng.standard_normal((30, 6)) for c in 3 * rng.standard_normal((3, 6))])
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")
    want = {r.id: r.cluster_label for r in density.density_clusters(rows, "id", "v").collect()}
    cuts = []
    monkeypatch.setattr(density, "cut", lambda df: cuts.append(df) or cut(df))
    monkeypatch.setattr(density, "ROWS_AT_ONCE", 400)
    assert {r.id: r.cluster_label for r in density.spread_clusters(rows, "id", "v", block=20).collect()} == want
    assert len(set(want.values())) > 1 and len(cuts) == 2 + 2 * 3  # two tables, and two passes of three rounds
