"""The SQL that each query equals, for an engine with RE2 patterns and list functions."""

from __future__ import annotations

from math import pi

from docloom.functions.abbreviations import FORM_FIRST
from docloom.functions.vectorize import STOP_WORDS, TOKEN
from docloom.operators.events import ACTIVITY, AGENT, CODE, CONDITION, EVALUEE, HOURS, TIME, TRIGGER, WEEKS
from docloom.operators.nested import SECTION_KEYS
from docloom.plans import fixtures

#: Whitespace of any kind, spelled out.
S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, {_q(S + '+')}, ' ', 'g'))"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, {_q(f'^{S}+|{S}+$')}, '', 'g')"


def _norm(t: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _stem(p: str) -> str:
    return rf"regexp_replace(regexp_extract({p}, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1')"


_TF = f"""d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents), n AS (SELECT count(*) AS n FROM d),
tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), {_q(TOKEN)})) AS term FROM d), tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM tok GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, cast(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n)),
w AS (SELECT doc_id, lang, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1), u AS (SELECT w.doc_id, lang, term, w / nrm AS w FROM w JOIN nrm USING (doc_id))"""
_PAIRS = f"{_TF}, p AS (SELECT a.lang, a.doc_id AS i, b.doc_id AS j, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.lang = b.lang AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3 HAVING sum(a.w * b.w) >= 0.45)"
_HEURISTIC = """CASE WHEN ta = tb THEN 'semantically_identical' WHEN length(ta) > 200 AND length(tb) > 200 AND (contains(ta, tb) OR contains(tb, ta)) THEN 'one_doc_included'
WHEN similarity >= 0.85 THEN 'semantically_identical' WHEN similarity >= 0.65 THEN 'possible_duplicate' ELSE 'candidate' END"""
_REASON = """CASE WHEN ta = tb THEN 'The normalized document text is exactly the same.' WHEN length(ta) > 200 AND length(tb) > 200 AND (contains(ta, tb) OR contains(tb, ta)) THEN 'One normalized document text is contained in the other.'
WHEN similarity >= 0.85 THEN 'Very high TF-IDF cosine similarity; review recommended.' WHEN similarity >= 0.65 THEN 'High TF-IDF cosine similarity; semantic review recommended.' ELSE 'Above candidate threshold; needs semantic or SME review.' END"""
_BEST = f"{_PAIRS}, best AS (SELECT p.*, {_norm('a.text')} AS ta, {_norm('b.text')} AS tb FROM (SELECT * FROM p ORDER BY similarity DESC, i, j LIMIT %d) p JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j)"

_LABEL = f"coalesce({_strip('llm_relationship_type')}, '')"
_NAME = f"CASE {_LABEL} WHEN '' THEN 'Other' WHEN 'semantically_identical' THEN 'Duplicated' WHEN 'one_doc_included' THEN 'Partial inclusion' WHEN 'conflict_in_information' THEN 'Contradiction' WHEN 'none_of_above' THEN 'Unrelated' ELSE {_LABEL} END"
_RANK = "CASE relationship WHEN 'Duplicated' THEN 0 WHEN 'Partial inclusion' THEN 1 WHEN 'Contradiction' THEN 2 WHEN 'Unrelated' THEN 3 ELSE 99 END"


def _node(k: int, level: str) -> str:
    if level == "document_type":
        return f"coalesce(nullif(trim(item{k}_type), ''), 'document')"
    return f"coalesce(nullif(trim(item{k}_title), ''), {_stem(f'trim(coalesce(item{k}_path, {_q(str())}))')})"


def _links(level: str) -> str:
    pick = lambda c: f"(list({c} ORDER BY weight DESC, coalesce(try_cast(source_id AS BIGINT), 0), coalesce(try_cast(target_id AS BIGINT), 0), coalesce(source_path, '') DESC, coalesce(target_path, '') DESC) FILTER ({c} IS NOT NULL))[1] AS {c}"
    side = lambda c: f"CASE WHEN n1 <= n2 THEN item1_{c} ELSE item2_{c} END AS source_{c}, CASE WHEN n1 <= n2 THEN item2_{c} ELSE item1_{c} END AS target_{c}"
    return f"""raw AS (SELECT *, {_NAME} AS relationship, try_cast(cross_encoder_similarity_value AS DOUBLE) AS weight, {_node(1, level)} AS n1, {_node(2, level)} AS n2 FROM llm_analyzed_duplicates WHERE NOT starts_with(upper({_LABEL}), 'SKIPPED')),
pairs AS (SELECT relationship, least(n1, n2) AS source_node, greatest(n1, n2) AS target_node, weight, {side('title')}, {side('path')}, CASE WHEN n1 <= n2 THEN cast(item1_id AS VARCHAR) ELSE cast(item2_id AS VARCHAR) END AS source_id,
 CASE WHEN n1 <= n2 THEN cast(item2_id AS VARCHAR) ELSE cast(item1_id AS VARCHAR) END AS target_id, llm_analysis FROM raw WHERE weight > 0 AND NOT isnan(weight) AND relationship <> 'Unrelated'),
links AS (SELECT relationship, source_node, target_node, sum(weight) AS weight, count(*) AS pair_count, avg(weight) AS avg_weight, max(weight) AS max_weight, {', '.join(map(pick, ('source_id', 'target_id', 'source_path', 'target_path', 'source_title', 'target_title', 'llm_analysis')))} FROM pairs GROUP BY 1, 2, 3)"""


_TOTALS = "(SELECT node, sum(weight) AS total FROM (SELECT source_node AS node, weight FROM {0} UNION ALL SELECT target_node, weight FROM {0} WHERE source_node <> target_node) GROUP BY 1)"
_SMALL = f"""{_links('title')}, totals0 AS {_TOTALS.format('links')}, top AS (SELECT node FROM totals0 ORDER BY total DESC, node LIMIT 64),
between AS (SELECT * FROM links WHERE source_node IN (SELECT node FROM top) AND target_node IN (SELECT node FROM top)),
few AS (SELECT * FROM between ORDER BY weight DESC, relationship, source_node, target_node LIMIT 450), totals AS (SELECT * FROM {_TOTALS.format('few')} WHERE total > 0)"""
_ARCS = f"""{_SMALL}, m AS (SELECT node, total, count(*) OVER () AS n, sum(total) OVER () AS grand, total / max(total) OVER () AS share FROM totals),
g AS (SELECT *, radians(greatest(1.2, least(4.0, 90.0 / n))) AS gap FROM m), sp AS (SELECT *, (2 * {pi!r} - gap * n) * total / grand AS span FROM g),
st AS (SELECT *, {pi / 2!r} - coalesce(sum(span + gap) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start" FROM sp),
arcs AS (SELECT node, total, share, "start", "start" - span AS "end", "start" - span / 2 AS mid FROM st)"""
_PORTS = f"""{_ARCS}, ends AS (SELECT relationship, source_node, target_node, weight, 'source' AS side, source_node AS node, target_node AS other FROM few UNION ALL SELECT relationship, source_node, target_node, weight, 'target', target_node, source_node FROM few),
j AS (SELECT e.*, a."start", a."end", o.mid AS other_angle, {_RANK} AS rk, count(*) OVER (PARTITION BY e.node) AS n, sum(e.weight) OVER (PARTITION BY e.node) AS heavy FROM ends e JOIN arcs a ON a.node = e.node JOIN arcs o ON o.node = e.other),
k AS (SELECT *, CASE WHEN n > 1 THEN 0.10 ELSE 0.50 END AS margin, least(0.018, 0.18 / greatest(n - 1, 1)) AS gap FROM j), l AS (SELECT *, greatest(0.18, 1.0 - margin * 2 - gap * greatest(n - 1, 0)) * weight / heavy AS span FROM k),
q AS (SELECT *, coalesce(sum(span + gap) OVER (PARTITION BY node ORDER BY other_angle, rk, weight DESC, side, relationship, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT relationship, source_node, target_node, side, node, round("start" + ("end" - "start") * least(1.0, greatest(0.0, margin + before + span / 2)), 6) AS angle FROM q"""

_VECTORS = "(SELECT {0}, embedding::DOUBLE[] AS v FROM {1} WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND isfinite(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) {2})"


def _cohesion(table: str, keys: str, where: str = "") -> str:
    named = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in named)
    on = " AND ".join(f"g.{k} = p.{k}" for k in named)
    return f"""WITH u AS (SELECT *, row_number() OVER () AS r FROM {_VECTORS.format(keys, table, where)}), p AS (SELECT {', '.join(f'a.{k}' for k in named)}, avg(list_cosine_similarity(a.v, b.v)) AS s FROM u a JOIN u b ON {same} AND a.r < b.r GROUP BY ALL),
g AS (SELECT DISTINCT {keys} FROM u) SELECT {', '.join(f'g.{k}' for k in named)}, round(coalesce(s, 0.0), 6) AS average_pairwise_similarity FROM g LEFT JOIN p ON {on}"""


_SHARES = "SELECT cluster_label, {0}, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster_label), 6) AS percentage FROM aggregated_vectors WHERE cluster_label IS NOT NULL AND {0} IS NOT NULL GROUP BY cluster_label, {0}"
_STATS = "SELECT cluster_label, count(verse_number) AS num_verses, round(avg(chapter), 6) AS avg_chapter, round(avg(verse_number), 6) AS avg_verse_number FROM aggregated_vectors WHERE cluster_label IS NOT NULL GROUP BY 1"
_SENTENCES = rf"""split AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace({{0}}, '([.!?])[\s\x{{{{0B}}}}]+([A-Z])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda s: {_strip('s').replace('{', '{{').replace('}', '}}')}), lambda s: s <> '') AS l FROM {{1}}),
sent AS (SELECT doc_id, cast(generate_subscripts(l, 1) - 1 AS INTEGER) AS sentence_index, unnest(l) AS sentence FROM split)"""
_STOP = "[" + ", ".join(map(_q, STOP_WORDS)) + "]"

_BOM = "chr(65279)"
_SECTION_KEYS = "|".join(SECTION_KEYS)
_NODES = rf"""WITH b AS (SELECT raw_id, ltrim(trim(body, chr(32) || chr(9) || chr(10) || chr(13)), {_BOM}) AS t FROM procedure_raw WHERE raw_id IS NOT NULL AND body IS NOT NULL),
w AS (SELECT raw_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN ltrim(json_extract_string(t, '$'), {_BOM}) ELSE t END END AS j FROM b),
o AS MATERIALIZED (SELECT raw_id, j FROM w WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END),
n AS (SELECT raw_id, type, regexp_replace(regexp_replace(regexp_replace(fullkey, '^\$\.', ''), '\.("[^"]*"|[^."\[\]]+)', '/\1', 'g'), '\[(\d+)\]', '/\1', 'g') AS a FROM o, json_tree(o.j)),
k AS (SELECT raw_id, type, replace(a, '"', '') AS node_address FROM n)
SELECT raw_id, node_address, CASE WHEN node_address LIKE 'metadata/%' THEN 'metadata' WHEN node_address = 'metadata' THEN '' ELSE regexp_replace(node_address, '(^|/)[a-z]+(/\d+)*$', '') END AS parent_address FROM k
WHERE node_address = 'metadata' AND type = 'OBJECT' OR regexp_matches(node_address, '^metadata/[^/]+$') AND type = 'OBJECT'
OR regexp_matches(node_address, '^sections(/\d+|/({_SECTION_KEYS}))*$') AND (type = 'OBJECT' OR type = 'VARCHAR' AND regexp_matches(node_address, '/\d+$'))"""

#: Patterns whose first group ends before something: that something may be read too where only the first match counts.
_ENDS = {name: pattern.replace("(?=", "(?:") for name, pattern in (("condition", CONDITION), ("time", TIME))}


def _expression(t: str) -> str:
    """The columns of a condition's expression; ``t`` is its trimmed text."""
    hours, low, high = (f"nullif(regexp_extract({t}, {_q(p)}, {k}), '')" for p, k in ((HOURS, 1), (WEEKS, 1), (WEEKS, 2)))
    pick = lambda less, between, other="NULL": f"CASE WHEN {t} IS NULL THEN NULL WHEN {hours} IS NOT NULL THEN {less} WHEN {low} IS NOT NULL THEN {between} ELSE {other} END"
    return f"""{t} AS text, {pick("'lessThan'", "'betweenInclusive'")} AS operator, {pick("'client.accumulatedInsurableHours'", "'claim.BPCWeek'")} AS "left", {pick(f"cast({hours} AS INTEGER)", "NULL")} AS "right",
{pick("'hour'", "NULL")} AS unit, {pick("NULL", f"cast({low} AS INTEGER)")} AS lower, {pick("NULL", f"cast({high} AS INTEGER)")} AS upper, {pick("NULL", "NULL", "'unresolved'")} AS "normalizationStatus\""""


_EVENTS = f"""pol AS (SELECT * FROM {fixtures.values(fixtures.POLICIES, 'doc_id, text')}), {_SENTENCES.format('text', 'pol')},
ev0 AS (SELECT *, regexp_extract_all(sentence, {_q(TRIGGER)}, 1)[-1] AS trigger, nullif(regexp_extract(sentence, {_q(_ENDS['condition'])}, 1), '') AS cond0, nullif(regexp_extract(sentence, {_q(_ENDS['time'])}, 1), '') AS time_text,
 nullif(regexp_extract(sentence, {_q(AGENT)}, 0), '') AS agent, nullif(regexp_extract(sentence, {_q(EVALUEE)}, 0), '') AS evaluee, nullif(upper(regexp_extract(sentence, {_q(CODE)}, 4)), '') AS own FROM sent WHERE regexp_matches(sentence, {_q(TRIGGER)})),
ev AS (SELECT *, trim(cond0, ' ,') AS cond, CASE WHEN contains(lower(trigger), 'terminat') THEN 'PenaltyTermination' WHEN contains(lower(trigger), 'rescind') THEN 'PenaltyRescission' WHEN contains(lower(trigger), 'suspend') THEN 'PenaltySuspension' ELSE 'PenaltyImposition' END AS event_type,
 last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM ev0)"""
#: First and last place (from 0) of a value in the sentence, letter case aside.
_FIRST, _LAST = "instr(lower(sentence), lower({0})) - 1", "CASE WHEN contains(lower(sentence), lower({0})) THEN length(sentence) - instr(reverse(lower(sentence)), reverse(lower({0}))) + 1 - length({0}) ELSE -1 END"
_BEZIER = "(1 - {t}) * (1 - {t}) * (1 - {t}) * {0} + 3 * (1 - {t}) * (1 - {t}) * {t} * {1} + 3 * (1 - {t}) * {t} * {t} * {2} + {t} * {t} * {t} * {3}"


def _on_chord(axis: str, along: str, sign: str) -> str:
    """A coordinate of the 25th point of a chord between the angles a and b."""
    straight = _BEZIER.format(f"{axis}(a)", f"0.22 * {axis}(a)", f"0.22 * {axis}(b)", f"{axis}(b)", t="(24 / 47.0)")
    middle, step = f"1.38 * {axis}((a + b) / 2)", f"{sign}0.18 * {along}((a + b) / 2)"
    loop = _BEZIER.format(f"{axis}(a)", f"({middle} - ({step}))", f"({middle} + ({step}))", f"{axis}(b)", t="(24 / 53.0)")
    return f"round(CASE WHEN source_node = target_node THEN {loop} ELSE {straight} END, 5)"


_REPLIES = rf"""r AS (SELECT id, trim(reply) AS t, regexp_extract(trim(reply), '(?is)^```(?:json)?\s*(.*?)\s*```$', 1) AS f FROM {fixtures.values(fixtures.REPLIES, 'id, reply')}),
b AS (SELECT id, trim(CASE WHEN f <> '' THEN f ELSE t END) AS b FROM r), j AS (SELECT *, CASE WHEN json_valid(b) THEN json_type(b) = 'OBJECT' ELSE false END AS ok FROM b),
k AS (SELECT *, CASE WHEN ok THEN trim(coalesce(json_extract_string(b, '$.relationship_type'), '')) ELSE 'parse_error' END AS kind, CASE WHEN ok THEN coalesce(json_extract_string(b, '$.analysis'), '') ELSE b END AS why FROM j)"""
_EXEMPLARS = f"SELECT frame, lexical_unit, sentence_id, {_strip('text')} AS text, cast(row_number() OVER (PARTITION BY {{0}} ORDER BY sentence_id, lexical_unit_id) AS INTEGER) AS place FROM {fixtures.values(fixtures.EXAMPLES, 'frame, lexical_unit, lexical_unit_id, sentence_id, text')} QUALIFY place <= 2"
_PLAIN = f"trim(regexp_replace(regexp_replace(coalesce({{0}}, ''), '</?[^>]+>', '', 'g'), {_q(S + '+')}, ' ', 'g'))"

_FORMS = """unnest(CASE WHEN contains(l, ' ') THEN [l] WHEN p = 'v' AND ends_with(l, 'e') THEN [l, l || 'd', l || 's', substring(l, 1, length(l) - 1) || 'ing'] WHEN p = 'v' AND ends_with(l, 'y') THEN [l, substring(l, 1, length(l) - 1) || 'ied', substring(l, 1, length(l) - 1) || 'ies', l || 'ing']
WHEN p = 'v' THEN [l, l || 'ed', l || 's', l || 'ing', l || 'es'] WHEN p = 'n' AND regexp_matches(l, '(s|x|z|ch|sh)$') THEN [l, l || 'es'] WHEN p = 'n' THEN [l, l || 's'] ELSE [l] END)"""
_FRAMES = rf"""{_EVENTS}, e AS (SELECT *, CASE event_type WHEN 'PenaltyImposition' THEN 'Rewards_and_punishments' WHEN 'PenaltyTermination' THEN 'Activity_stop' WHEN 'PenaltySuspension' THEN 'Activity_pause' END AS frame FROM ev),
lu AS (SELECT *, regexp_replace(u, '\.[^.]*$', '') AS l, regexp_extract(u, '[^.]*$') AS p FROM {fixtures.values([(name, u) for name, _, _, units in fixtures.FRAMES for u in units], 'frame, u')}),
fe AS (SELECT frame, list(n) AS known FROM {fixtures.values([(name, n) for name, _, names, _ in fixtures.FRAMES for n in names], 'frame, n')} GROUP BY 1), form AS (SELECT frame, u, {_FORMS} AS f FROM lu),
hit AS (SELECT doc_id, sentence_index, u FROM e JOIN form USING (frame) WHERE regexp_matches(sentence, '(?i)\b' || f || '\b') QUALIFY row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY length(regexp_extract(sentence, '(?is)^(.*?)\b' || f || '\b', 1)), -length(f), u) = 1),
n AS (SELECT e.*, known, u, list_filter(CASE WHEN event_type = 'PenaltyImposition' THEN ['Agent', 'Evaluee', 'Response_action', CASE WHEN cond IS NOT NULL THEN 'Reason' END, CASE WHEN time_text IS NOT NULL THEN 'Time' END]
 WHEN frame IS NULL THEN [] ELSE ['Agent', 'Activity', CASE WHEN cond IS NOT NULL THEN 'Explanation' END, CASE WHEN time_text IS NOT NULL THEN 'Time' END] END, lambda x: x IS NOT NULL) AS names FROM e LEFT JOIN fe USING (frame) LEFT JOIN hit USING (doc_id, sentence_index))"""

SQL: dict[str, str] = {
    "p6_found": _NODES,
    "dup_pairs_tfidf": f"WITH {_PAIRS} SELECT * FROM p",
    "dup_pairs_labelled": f"WITH {_BEST % 500} SELECT lang AS cluster_label, true AS same_cluster, i AS item1_id, j AS item2_id, similarity, {_HEURISTIC} AS relationship, {_REASON} AS analysis FROM best",
    "label_status": f"WITH {_BEST % 500} SELECT i AS item1_id, j AS item2_id, {_HEURISTIC} AS heuristic_relationship_type, 'SKIPPED_NO_API_KEY' AS llm_relationship_type, '' AS llm_analysis FROM best",
    "tfidf_vocab": f"WITH {_TF} SELECT term, df, total_tf FROM vocab",
    "tfidf_vocab_bigrams": f"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), {_q(TOKEN)}), lambda t: NOT list_contains({_STOP}, t)) AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS term FROM l UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM l), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)
SELECT term, count(*) AS df, cast(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents) ORDER BY total_tf DESC, term LIMIT 50000""",
    "tfidf_weights": f"WITH {_TF} SELECT doc_id, term, round(w, 6) AS weight FROM u",
    "emb_pairs_within": "SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3",
    "emb_pairs_all": "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4",
    "exact_dups": f"WITH d AS (SELECT doc_id, {_norm('text')} AS k FROM documents) SELECT doc_id, group_id, copies FROM d JOIN (SELECT k, min(doc_id) AS group_id, count(*) AS copies FROM d GROUP BY k HAVING count(*) > 1) USING (k)",
    "cluster_type_counts": "SELECT cluster_label, document_type, count(*) AS count FROM procedure_documents GROUP BY 1, 2",
    "run_summary": """SELECT (SELECT count(*) FROM procedure_documents) AS document_count, (SELECT count(DISTINCT cluster_label) FROM procedure_documents) AS cluster_count, count(*) AS candidate_pair_count, count(*) AS cross_encoder_scored_pair_count,
cast(coalesce(sum(cast(cross_encoder_passed AS INTEGER)), 0) AS BIGINT) AS cross_encoder_passed_pair_count, count(*) FILTER (cross_encoder_passed) AS final_pair_count, 0.45::DOUBLE AS similarity_threshold FROM duplicate_pairs""",
    "path_parts": f"SELECT document_id, CASE WHEN path IS NULL THEN '' WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE '' END AS type_of_path, {_stem('path')} AS stem FROM procedure_documents",
    "title_chain": f"SELECT document_id, coalesce(nullif({_squeeze('coalesce(title, {0})'.format(_q('')))}, ''), nullif({_stem('path')}, ''), 'untitled') AS title FROM procedure_documents",
    "pair_endpoints": "SELECT pair_id, item1_id, item2_id, a.title AS item1_title, b.title AS item2_title, a.document_type AS item1_doc_type, b.document_type AS item2_doc_type FROM duplicate_pairs JOIN procedure_documents a ON a.document_id = item1_id JOIN procedure_documents b ON b.document_id = item2_id",
    "rerank_skip": "SELECT pair_id, round(similarity, 6) AS cross_encoder_similarity_value, true AS cross_encoder_passed FROM duplicate_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity)",
    "passed_pairs": "SELECT pair_id, item1_type, cross_encoder_similarity_value FROM duplicate_pairs WHERE item1_type IN ('task', 'activity') AND item2_type IN ('task', 'activity') AND item1_type = item2_type AND cross_encoder_similarity_value > 0.5",
    "top_pairs": "SELECT DISTINCT item1_id, item2_id, similarity, cross_encoder_similarity_value FROM duplicate_pairs WHERE NOT isnan(similarity) AND NOT isnan(cross_encoder_similarity_value) ORDER BY cross_encoder_similarity_value DESC, similarity DESC, item1_id NULLS FIRST, item2_id NULLS FIRST LIMIT 100",
    "unordered_pairs": "SELECT least(item1_id, item2_id) AS a, greatest(item1_id, item2_id) AS b, count(*) AS n FROM duplicate_pairs WHERE item1_id IS NOT NULL AND item2_id IS NOT NULL GROUP BY 1, 2",
    "model_texts": "SELECT document_id, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(summary), ''), nullif(left(trim(text), 2500), '')) AS model_text FROM procedure_documents",
    "cluster_statistics": _STATS,
    "largest_clusters": f"SELECT cluster_label, num_verses FROM ({_STATS}) ORDER BY num_verses DESC, cluster_label LIMIT 4",
    "cluster_share_source": _SHARES.format("source"),
    "cluster_share_chapter": _SHARES.format("chapter"),
    "cluster_top_chapters": f"SELECT *, cast(row_number() OVER (PARTITION BY cluster_label ORDER BY percentage DESC, chapter) AS INTEGER) AS place FROM ({_SHARES.format('chapter')}) QUALIFY place <= 5",
    "cohesion_by_label": _cohesion("embeddings", "label"),
    "cohesion_by_chapter": _cohesion("aggregated_vectors", "chapter", "AND chapter IS NOT NULL"),
    "cohesion_by_source_chapter": _cohesion("aggregated_vectors", "source, chapter", "AND chapter IS NOT NULL AND source IS NOT NULL"),
    "cohesion_top_chapters": f"SELECT *, cast(row_number() OVER (PARTITION BY source ORDER BY average_pairwise_similarity DESC, chapter) AS INTEGER) AS place FROM ({_cohesion('aggregated_vectors', 'source, chapter', 'AND chapter IS NOT NULL AND source IS NOT NULL')}) QUALIFY place <= 5",
    "graph_links": f"WITH {_links('document_type')} SELECT relationship, source_node, target_node, round(weight, 6) AS weight, pair_count, round(avg_weight, 6) AS avg_weight, round(max_weight, 6) AS max_weight FROM links",
    "graph_links_by_title": f"WITH {_links('title')} SELECT relationship, source_node, target_node, round(weight, 6) AS weight, pair_count, source_id, target_id, source_path, target_path, llm_analysis FROM links",
    "graph_nodes": f"WITH {_links('title')} SELECT node, round(total, 6) AS total FROM {_TOTALS.format('links')}",
    "graph_filtered": f"WITH {_SMALL} SELECT relationship, source_node, target_node, round(weight, 6) AS weight, pair_count FROM few",
    "graph_filtered_nodes": f"WITH {_SMALL} SELECT node, round(total, 6) AS total FROM totals",
    "graph_counts": f"WITH {_SMALL} SELECT count(*) AS links, cast(sum(pair_count) AS BIGINT) AS pairs, round(sum(weight), 6) AS weight, cast((SELECT count(*) FROM totals0) AS INTEGER) AS all_nodes, cast((SELECT count(*) FROM between) AS INTEGER) AS all_links FROM few",
    "graph_summary": f"WITH {_links('title')} SELECT relationship, count(*) AS links, cast(sum(pair_count) AS BIGINT) AS pairs, round(sum(weight), 6) AS weight FROM links GROUP BY 1",
    "graph_arcs": f"""WITH {_ARCS} SELECT node, round(total, 6) AS total, round(share, 6) AS share_of_largest, round("start", 6) AS "start", round("end", 6) AS "end", round(mid, 6) AS mid, round(CASE WHEN degrees(mid) < -90 OR degrees(mid) > 90 THEN degrees(mid) + 180 ELSE degrees(mid) END, 5) AS rotation FROM arcs""",
    "graph_ports": f"WITH {_PORTS}",
    "graph_widths": f"WITH {_SMALL} SELECT relationship, source_node, target_node, round(1.0 + (sqrt(weight) - min(sqrt(weight)) OVER ()) / (max(sqrt(weight)) OVER () - min(sqrt(weight)) OVER ()) * 17.0, 6) AS width FROM few",
    "graph_relationship_order": f"WITH {_links('title')} SELECT cast(row_number() OVER (ORDER BY {_RANK}, relationship) - 1 AS INTEGER) AS position, relationship FROM (SELECT DISTINCT relationship FROM links)",
    "graph_visibility": f"WITH {_SMALL}, t AS (SELECT DISTINCT relationship AS toggle FROM few) SELECT toggle, relationship, source_node, target_node, relationship = toggle AS visible FROM few, t",
    "graph_diff_records": f"""WITH {_SMALL}, r AS (SELECT *, coalesce(nullif({_squeeze("coalesce(source_title, '')")}, ''), source_node) AS st, coalesce(nullif({_squeeze("coalesce(target_title, '')")}, ''), target_node) AS tt FROM few)
SELECT 'pair-' || row_number() OVER (ORDER BY weight DESC, avg_weight DESC, relationship, source_node, target_node) AS id, st || ' ↔ ' || tt AS label, relationship, round(weight, 6) AS weight, pair_count AS "pairCount", coalesce(source_id, '') AS "sourceId", coalesce(target_id, '') AS "targetId", st AS "sourceTitle", tt AS "targetTitle", false AS "sourceTruncated" FROM r""",
    "node_level": "SELECT CASE WHEN count(DISTINCT t) >= 2 THEN 'document_type' ELSE 'title' END AS level, 'cross_encoder_similarity_value' AS weight FROM (SELECT item1_type AS t FROM llm_analyzed_duplicates UNION ALL SELECT item2_type FROM llm_analyzed_duplicates)",
    "sentences": f"WITH {_SENTENCES.format('coalesce(text, {0})'.format(_q('')), 'documents')} SELECT * FROM sent",
    "text_previews": f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS raw, {_squeeze("coalesce(text, '')")} AS t FROM documents), p AS (SELECT *, CASE WHEN length(t) <= 900 THEN t ELSE regexp_replace(left(t, 899), {_q(S + '+$')}, '') || '...' END AS preview FROM c)
SELECT doc_id, preview, CASE WHEN preview = '' THEN 'No text available' ELSE array_to_string(list_transform(range(0, length(preview), 96), lambda i: replace(replace(replace(replace(replace(substring(preview, i + 1, 96), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')), '<br>') END AS html,
CASE WHEN length(raw) > 20000 THEN regexp_replace(left(raw, 20000), {_q(S + '+$')}, '') ELSE raw END AS clipped, length(raw) > 20000 AS truncated FROM p""",
    "relationship_names": f"WITH r AS (SELECT {_NAME} AS relationship, starts_with(upper({_LABEL}), 'SKIPPED') AS skipped FROM llm_analyzed_duplicates) SELECT relationship, skipped, count(*) AS n, cast(min({_RANK}) AS INTEGER) AS rank FROM r GROUP BY 1, 2",
    "sigmoids": "SELECT pair_id, round(max(1 / (1 + exp(-similarity))), 6) AS sigmoid FROM duplicate_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1",
    "props_json": "SELECT event_type, cast(sum(cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "verse_keys": rf"SELECT id, CASE WHEN ok THEN trim(regexp_extract(key, p, 1)) END AS book, CASE WHEN ok THEN cast(regexp_extract(key, p, 2) AS INTEGER) END AS chapter, CASE WHEN ok THEN cast(regexp_extract(key, p, 3) AS INTEGER) END AS verse_number FROM (SELECT *, '^(\d?\s*[a-zA-Z\s]+)\s(\d+):(\d+)' AS p, regexp_matches(key, '^(\d?\s*[a-zA-Z\s]+)\s(\d+):(\d+)') AS ok FROM {fixtures.values(fixtures.VERSES, 'id, key')})",
    "acronym_defs": f"SELECT id, unnest(regexp_extract_all(text, {_q(FORM_FIRST)}, 2)) AS acronym, trim(unnest(regexp_extract_all(text, {_q(FORM_FIRST)}, 1))) AS full_form FROM {fixtures.values(fixtures.ACRONYMS, 'id, text')}",
    "events_core": f"""WITH pol AS (SELECT * FROM {fixtures.values(fixtures.POLICIES, 'doc_id, text')}), {_SENTENCES.format('text', 'pol')},
t AS (SELECT *, regexp_extract_all(sentence, {_q(TRIGGER)}, 1)[-1] AS trigger, length(sentence) - length(string_split_regex(sentence, {_q(TRIGGER)})[-1]) AS e FROM sent WHERE regexp_matches(sentence, {_q(TRIGGER)})),
k AS (SELECT *, CASE WHEN contains(lower(trigger), 'terminat') THEN 'PenaltyTermination' WHEN contains(lower(trigger), 'rescind') THEN 'PenaltyRescission' WHEN contains(lower(trigger), 'suspend') THEN 'PenaltySuspension' ELSE 'PenaltyImposition' END AS event_type, nullif(upper(regexp_extract(sentence, {_q(CODE)}, 4)), '') AS own, regexp_extract(sentence, {_q(CODE)}, 1) AS num FROM t),
c AS (SELECT *, last_value(CASE WHEN own IS NOT NULL THEN {{'c': own, 'n': try_cast(nullif(num, '') AS INTEGER)}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM k),
v AS (SELECT *, CASE WHEN event_type = 'PenaltyImposition' AND own IS NULL THEN NULL ELSE carried END AS pen FROM c)
SELECT doc_id, sentence_index, event_type, CASE event_type WHEN 'PenaltyImposition' THEN 'Rewards_and_punishments' WHEN 'PenaltyTermination' THEN 'Activity_stop' WHEN 'PenaltySuspension' THEN 'Activity_pause' END AS frame, trigger, cast(e - length(trigger) AS INTEGER) AS trigger_start,
CASE WHEN contains(lower(trigger), 'not') THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN contains(lower(trigger), 'must') THEN 'required' WHEN contains(lower(trigger), 'cannot') THEN 'prohibited' ELSE 'asserted' END AS modality, pen.c AS code, pen.n AS number,
nullif(regexp_extract(sentence, '(?i)\\b(the\\s+(?:officer|agent|system|Commission)|Service Canada)\\b', 0), '') AS agent, nullif(regexp_extract(sentence, '(?i)\\b(the\\s+client|clients|the\\s+claimant|claimants)\\b', 0), '') AS evaluee FROM v""",
    "condition_expressions": f"SELECT id, {_expression('t')} FROM (SELECT id, trim(text, ' ,') AS t FROM {fixtures.values(fixtures.CONDITIONS, 'id, text')})",
    "events_conditions": f"WITH {_EVENTS} SELECT doc_id, sentence_index, {_expression('cond')}, time_text FROM ev",
    "events_evidence": f"""WITH {_EVENTS}, r AS (SELECT doc_id, sentence_index, event_type, unnest([{{'role': 'Agent', 'v': agent}}, {{'role': 'Evaluee', 'v': evaluee}}, {{'role': 'Condition', 'v': cond0}}, {{'role': 'Time', 'v': time_text}}]) AS r FROM ev)
SELECT doc_id, sentence_index, event_type, r.role AS role, CASE WHEN r.v IS NULL THEN 'implicit_or_unresolved' ELSE 'domain_rule' END AS method, NULL AS relation FROM r""",
    "highlight_segments": f"""WITH {_EVENTS}, code AS (SELECT *, CASE WHEN event_type = 'PenaltyImposition' THEN own ELSE carried END AS code FROM ev),
span AS (SELECT doc_id, sentence_index, sentence, unnest([{{'k': 'reason', 'p': 1, 'a': {_FIRST.format('cond')}, 'n': length(cond)}}, {{'k': 'code', 'p': 7, 'a': {_FIRST.format('code')}, 'n': length(code)}}, {{'k': 'trigger', 'p': 8, 'a': {_LAST.format('trigger')}, 'n': length(trigger)}}]) AS s FROM code),
ch AS (SELECT doc_id, sentence_index, sentence, unnest(range(0, length(sentence))) AS i FROM code),
paint AS (SELECT c.doc_id, c.sentence_index, c.sentence, c.i, arg_max(s.s.k, s.s.p) AS type FROM ch c LEFT JOIN span s ON s.doc_id = c.doc_id AND s.sentence_index = c.sentence_index AND s.s.a >= 0 AND s.s.a <= c.i AND c.i < s.s.a + s.s.n GROUP BY ALL),
new AS (SELECT *, CASE WHEN i = 0 OR type IS DISTINCT FROM lag(type) OVER w THEN 1 ELSE 0 END AS fresh FROM paint WINDOW w AS (PARTITION BY doc_id, sentence_index ORDER BY i)),
seg AS (SELECT *, cast(sum(fresh) OVER (PARTITION BY doc_id, sentence_index ORDER BY i) - 1 AS BIGINT) AS segment FROM new)
SELECT doc_id, sentence_index, segment, cast(min(i) AS INTEGER) AS "start", cast(max(i) + 1 AS INTEGER) AS "end", type, substring(any_value(sentence), cast(min(i) + 1 AS BIGINT), cast(max(i) + 1 - min(i) AS BIGINT)) AS text FROM seg GROUP BY doc_id, sentence_index, segment, type""",
    "graph_curves": f"""WITH p AS ({{0}}), e AS (SELECT relationship, source_node, target_node, max(angle) FILTER (side = 'source') AS a, max(angle) FILTER (side = 'target') AS b FROM p GROUP BY 1, 2, 3)
SELECT relationship, source_node, target_node, CASE WHEN source_node = target_node THEN 54 ELSE 48 END AS points, round(cos(a), 5) AS x0, {_on_chord('cos', 'sin', '-')} AS x24, {_on_chord('sin', 'cos', '')} AS y24, round(sin(b), 5) AS y1 FROM e""".replace("{0}", f"WITH {_PORTS}".replace("6) AS angle", "14) AS angle")),
    "graph_search": f"""WITH {_SMALL}, r AS (SELECT *, coalesce(nullif({_squeeze("coalesce(source_title, '')")}, ''), source_node) AS st, coalesce(nullif({_squeeze("coalesce(target_title, '')")}, ''), target_node) AS tt FROM few),
n AS (SELECT 'pair-' || row_number() OVER (ORDER BY weight DESC, avg_weight DESC, relationship, source_node, target_node) AS id, * FROM r)
SELECT id, relationship FROM n WHERE contains(lower(concat_ws(' ', st || ' ↔ ' || tt, relationship, coalesce(source_path, ''), coalesce(target_path, ''))), 'partial')""",
    "model_replies": f"WITH {_REPLIES} SELECT id, CASE WHEN ok AND kind IN ('semantically_identical', 'one_doc_included', 'conflict_in_information', 'none_of_above') THEN kind ELSE 'parse_error' END AS relationship_type, CASE WHEN ok AND kind IN ('semantically_identical', 'one_doc_included', 'conflict_in_information', 'none_of_above') THEN why ELSE 'Invalid relationship_type from model: ' || chr(39) || kind || chr(39) || '. Raw analysis: ' || why END AS analysis FROM k",
    "frame_exemplars": _EXEMPLARS.replace("{0}", "frame"),
    "frame_exemplars_by_unit": _EXEMPLARS.replace("{0}", "frame, lexical_unit"),
    "frame_summaries": f"""SELECT name, id, {_PLAIN.replace('{0}', 'definition')} AS definition, coalesce(elements, '') AS elements, coalesce(lexical_units, '') AS lexical_units, coalesce(relations, '') AS relations FROM {fixtures.values(fixtures.DEFINITIONS, 'name, id, definition')}
LEFT JOIN (SELECT frame AS name, string_agg(e, '|' ORDER BY e) AS elements FROM (SELECT frame, name || ':' || core_type || ':' || {_PLAIN.replace('{0}', 'definition')} AS e FROM {fixtures.values(fixtures.ELEMENTS, 'frame, id, name, core_type, definition')}) GROUP BY 1) USING (name)
LEFT JOIN (SELECT frame AS name, string_agg(DISTINCT u, '|' ORDER BY u) AS lexical_units FROM {fixtures.values(fixtures.UNITS, 'frame, u')} GROUP BY 1) USING (name) LEFT JOIN (SELECT frame AS name, string_agg(r, '|' ORDER BY r) AS relations FROM {fixtures.values(fixtures.RELATIONS, 'frame, r')} GROUP BY 1) USING (name)""",
    "encoded_texts": """WITH c AS (SELECT doc_id, unnest(range(0, 26)) AS k, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT doc_id, k, length(t) - length(replace(t, chr(cast(97 + k AS INTEGER)), '')) AS n FROM c)
SELECT doc_id, cast(k AS INTEGER) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS x FROM n WHERE n > 0""",
    "csv_round_trip": "SELECT item1_id, item2_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("item1_title", "item2_path", "llm_relationship_type", "llm_analysis")) + " FROM llm_analyzed_duplicates",
    "verses_read": "SELECT trim(book) AS book, chapter, verse_number, min(text) AS text FROM aggregated_vectors WHERE source IS NOT NULL AND book IS NOT NULL AND chapter IS NOT NULL AND verse_number IS NOT NULL AND text IS NOT NULL AND regexp_matches(book, '^[a-zA-Z ]+$') GROUP BY source, book, chapter, verse_number",
    "p6_links_in_sections": rf"WITH n AS ({_NODES}) SELECT o.raw_id, o.node_address AS outer_address, l.node_address AS inner_address FROM n o JOIN n l ON o.raw_id = l.raw_id AND starts_with(l.node_address, o.node_address || '/') WHERE regexp_matches(o.node_address, '^sections(/\d+)*$') AND regexp_matches(l.node_address, '/links(/\d+)*$')",
    "events_frames": f"""WITH {_FRAMES} SELECT doc_id, sentence_index, CASE WHEN frame IS NULL THEN 'domain_event_only' WHEN u IS NOT NULL THEN 'validated_exact_lu' ELSE 'validated_frame_no_exact_lu' END AS "validationStatus", u AS "lexicalUnit",
coalesce(array_to_string(list_sort(names), ','), '') AS elements, CASE WHEN frame IS NOT NULL THEN coalesce(array_to_string(list_filter(names, lambda x: NOT list_contains(known, x)), ','), '') END AS invalid FROM n""",
}
