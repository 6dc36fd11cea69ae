"""The SQL that training-data queries equal on the test tables, for an engine with RE2 patterns and list functions.

The engine lacks Unicode decomposition and entities; replacement chains built by rule stand in, which
cover the characters and references that occur there.
"""

from __future__ import annotations

from html.entities import codepoint2name
from unicodedata import normalize

from docloom.functions.moments import MONTHS
from docloom.llm.skeleton import CYRILLIC, GREEK, HYPHENS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _skeleton(text: str) -> str:
    """A text in one form: composed, what takes no room out, look-alikes and widths replaced."""
    pairs = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]), " ") | CYRILLIC | GREEK
    for mark in "̀́̈":
        for a, b in (CYRILLIC | GREEK).items():
            one, other = normalize("NFC", a + mark), normalize("NFC", b + mark)
            if len(one) == 1 and len(other) == 1:
                pairs[one] = other
    seen = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
    out = f"regexp_replace(nfc_normalize({text}), '{seen}', '', 'g')"
    for k, plain in enumerate(("ff", "fi", "fl", "ffi", "ffl")):
        out = f"replace({out}, chr({0xFB00 + k}), '{plain}')"
    return f"nfc_normalize(translate({out}, {_q(''.join(pairs))}, {_q(''.join(pairs.values()))}))"


def _entities(text: str) -> str:
    """References of Latin-1 letters and the usual marks, by number and by name."""
    out = text
    for code in [*range(0xA0, 0x100), 39, 34, 60, 62, 0x2019, 38]:
        char = f"chr({code})"
        out = f"replace({out}, '&#{code};', {char})"
        if code in codepoint2name:
            out = f"replace({out}, '&{codepoint2name[code]};', {char})"
    return out


def _moment() -> str:
    """Microseconds since 1970 of the text ``t``, null where it denotes no moment."""
    part = lambda pattern, k: f"regexp_extract(t, {_q(pattern)}, {k})"
    names = "MAP {" + ", ".join(f"'{name}': '{k:02d}'" for k, every in MONTHS.items() for name in every.split()) + "}"
    month = lambda name: f"element_at({names}, lower({name}))[1]"
    two = lambda day: f"lpad({day}, 2, '0')"
    numbers = r"^(\d{4})[-/](\d{2})[-/](\d{2})(?:[T +](\d{2}:\d{2}:\d{2}))?(Z|[+-]\d{2}:\d{2})?$"
    dots, day_name, name_day = r"^(\d{2})\.(\d{2})\.(\d{4})$", r"^(\d{1,2})[ -]([\p{L}]+)[ -](\d{4})$", r"^([\p{L}]+) (\d{1,2}), (\d{4})$"
    clock = f"(CASE WHEN {part(numbers, 4)} = '' THEN '00:00:00' ELSE {part(numbers, 4)} END) || (CASE WHEN {part(numbers, 5)} IN ('', 'Z') THEN '+00' ELSE {part(numbers, 5)} END)"
    midnight = "'00:00:00+00'"

    def when(pattern: str, y: str, m: str, d: str, rest: str) -> str:
        return f"WHEN regexp_matches(t, {_q(pattern)}) THEN epoch_us(try_cast({y} || '-' || {m} || '-' || {d} || ' ' || {rest} AS TIMESTAMPTZ))"

    return " ".join([
        r"CASE WHEN regexp_matches(t, '^\d{8}$') THEN epoch_us(try_cast(t[1:4] || '-' || t[5:6] || '-' || t[7:8] || ' 00:00:00+00' AS TIMESTAMPTZ))",
        r"WHEN regexp_matches(t, '^\d{10}$') THEN cast(t AS BIGINT) * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN cast(t AS BIGINT) * 1000",
        when(numbers, part(numbers, 1), part(numbers, 2), part(numbers, 3), clock),
        when(dots, part(dots, 3), part(dots, 2), part(dots, 1), midnight),
        when(day_name, part(day_name, 3), month(part(day_name, 2)), two(part(day_name, 1)), midnight),
        when(name_day, part(name_day, 3), month(part(name_day, 1)), two(part(name_day, 2)), midnight),
        "END",
    ])


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_USABLE = """raw AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN embedding::DOUBLE[] ELSE try_cast(embedding_str AS DOUBLE[]) END AS v FROM aggregated_vectors),
ok AS (SELECT vec_id, min(v) AS v FROM raw WHERE vec_id IS NOT NULL AND len(v) = 64 AND list_count(v) = 64 AND isfinite(list_inner_product(v, v)) AND list_inner_product(v, v) > 0 GROUP BY 1)"""
_CLOSE = f"{_USABLE}, sim AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM ok a JOIN ok b ON a.vec_id <> b.vec_id)"
_LABEL = r"regexp_replace(regexp_replace(lower(llm_relationship_type), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g')"
_RUN = "SELECT {0}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run FROM {1}"

_NEAR = rf"""WITH d AS (SELECT document_id, {_WORDS.format(_entities("coalesce(title, '') || ' ' || coalesce(text, '')"))} AS w FROM procedure_documents),
s AS (SELECT DISTINCT document_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 20), n AS (SELECT document_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT document_id, list_sort(list(g)) AS k FROM s GROUP BY 1),
o AS (SELECT a.document_id AS document_id_1, b.document_id AS document_id_2, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.document_id < b.document_id GROUP BY 1, 2),
p AS (SELECT document_id_1, document_id_2 FROM o JOIN n x ON x.document_id = document_id_1 JOIN n y ON y.document_id = document_id_2 WHERE 2 * o >= x.n + y.n - o)"""
_ROOT = r"lower(trim(regexp_extract(replace(url_decode(replace(path, '+', '%2B')), '\', '/'), '^(?:\s|/|\.+/)*([^/]*)', 1)))"

SQL: dict[str, str] = {
    "p1_found": rf"""WITH m AS (SELECT DISTINCT group_id, document_id FROM duplicate_groups WHERE group_id IS NOT NULL AND document_id IS NOT NULL QUALIFY min(document_id) OVER (PARTITION BY group_id) < max(document_id) OVER (PARTITION BY group_id)),
d AS (SELECT document_id, loaded_at, path, trim(regexp_replace(modified, '\s+', ' ', 'g')) AS t, len(list_distinct({_WORDS.format(_entities('text'))})) AS words, {_ROOT} AS root FROM procedure_documents),
s AS (SELECT document_id, loaded_at, nullif(words, 0) AS words, {_moment()} AS us, CASE WHEN path IS NOT NULL THEN coalesce(trust_rank, 1000000000) END AS trust FROM d LEFT JOIN (SELECT lower(root_name) AS root, min(trust_rank) AS trust_rank FROM path_roots GROUP BY 1) USING (root)),
f AS (SELECT group_id, document_id, 'text' AS field_name, cast(words AS BIGINT) AS score FROM m JOIN s USING (document_id) UNION ALL SELECT group_id, document_id, 'modified', CASE WHEN us >= epoch_us(TIMESTAMP '2000-01-01') AND us <= epoch_us(loaded_at) THEN us END FROM m JOIN s USING (document_id)
UNION ALL SELECT group_id, document_id, 'path', -trust FROM m JOIN s USING (document_id))
SELECT group_id, field_name, document_id FROM f WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY score DESC, document_id) = 1""",
    "p3_found": f"{_NEAR} SELECT document_id_1, document_id_2 FROM p",
    "p3_groups": f"""WITH RECURSIVE {_NEAR.removeprefix("WITH ")}, e AS (SELECT document_id_1 AS a, document_id_2 AS b FROM p UNION ALL SELECT document_id_2, document_id_1 FROM p),
reach(id, root) AS (SELECT DISTINCT document_id, document_id FROM s UNION SELECT b, root FROM reach JOIN e ON a = id), g AS (SELECT id, min(root) AS group_id FROM reach GROUP BY 1),
same AS (SELECT a, count(*) AS copies FROM e JOIN k x ON x.document_id = a JOIN k y ON y.document_id = b WHERE x.k = y.k GROUP BY 1), every AS (SELECT a, count(*) AS c FROM e GROUP BY 1)
SELECT id AS document_id, group_id, coalesce(copies, 0) AS copies, coalesce(c, 0) - coalesce(copies, 0) AS links FROM g LEFT JOIN same ON same.a = id LEFT JOIN every ON every.a = id""",
    "p4_found": f"""WITH RECURSIVE {_CLOSE}, near AS (SELECT a, b FROM sim WHERE s >= 0.8), reach(id, root) AS (SELECT vec_id, vec_id FROM ok UNION SELECT b, root FROM reach JOIN near ON a = id),
g AS (SELECT id AS vec_id, min(root) AS cluster_key FROM reach GROUP BY 1) SELECT vec_id, cluster_key FROM g QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 15""",
    "p5_found": f"""WITH RECURSIVE p AS (SELECT DISTINCT least(item1_id, item2_id) AS a, greatest(item1_id, item2_id) AS b FROM duplicate_pairs WHERE item1_id IS NOT NULL AND item2_id IS NOT NULL AND item1_id <> item2_id),
l AS (SELECT DISTINCT least(item1_id, item2_id) AS a, greatest(item1_id, item2_id) AS b FROM llm_analyzed_duplicates WHERE item1_id IS NOT NULL AND item2_id IS NOT NULL AND {_LABEL} IN ('semantically_identical', 'one_doc_included')),
m AS (SELECT a, b FROM p JOIN l USING (a, b)), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach(id, root) AS (SELECT a, a FROM e UNION SELECT b, root FROM reach JOIN e ON a = id)
SELECT id AS item_id, min(root) AS group_id FROM reach GROUP BY 1""",
    "p7_found": f"WITH {_CLOSE}, top AS (SELECT a, b, s FROM sim QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) SELECT DISTINCT least(a, b) AS vec_id_1, greatest(a, b) AS vec_id_2 FROM top WHERE s >= 0.8",
    "p8_found": f"""WITH i AS (SELECT item_id, {_WORDS.format(_skeleton('text'))} AS w FROM eval_items), d AS (SELECT doc_id, {_WORDS.format(_skeleton('text'))} AS w FROM documents),
x AS ({_RUN.format('item_id', 'i WHERE len(w) >= 13')}), y AS ({_RUN.format('doc_id', 'd WHERE len(w) >= 13')}) SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (run)""",
    "p10_found": f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS t, {_skeleton("coalesce(text, '')")} AS k FROM documents)
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id AND a.t <> b.t""",
}
SQL["p8_report"] = f"SELECT item_id, count(doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_items WHERE item_id IS NOT NULL) LEFT JOIN ({SQL['p8_found']}) USING (item_id) GROUP BY 1"
SQL["p10_groups"] = f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS t, {_skeleton("coalesce(text, '')")} AS k FROM documents), g AS (SELECT k, min(doc_id) AS group_id, count(*) AS documents, count(DISTINCT t) AS variants FROM k GROUP BY 1)
SELECT doc_id, group_id, documents, variants FROM k JOIN g USING (k)"""
SQL["p1_records"] = f"""SELECT group_id, max(text) FILTER (field_name = 'text') AS text, max(modified) FILTER (field_name = 'modified') AS modified, max(path) FILTER (field_name = 'path') AS path,
max(document_id) FILTER (field_name = 'text') AS text_from, max(document_id) FILTER (field_name = 'modified') AS modified_from, max(document_id) FILTER (field_name = 'path') AS path_from FROM ({SQL["p1_found"]}) JOIN procedure_documents USING (document_id) GROUP BY 1"""
