import json

from docloom.operators.nested import _deep_loads, contained, label_nodes, node_table, type_tables, whole_object

BODY = {
    "metadata": {"ort.titles": {"en_title": "T"}, "dcterms.language": "en", "list": [{}]},
    "source": {"no": "node"},
    "sections": [{"text": "own", "children": [{"label": "a", "items": ["s1", ["s2", None, {}]]}, None], "other": [{"text": "unreached"}]}, "top string", [{"links": [{"text": "l", "href": "h"}]}], {"content": {"text": ["t1"]}}],
}
KIND = "raw_id long, body string, pre string, node_address int"


def addresses(body):
    return {n[5]: n[6] for n in label_nodes(body)}


def test_addresses_and_parents():
    assert addresses(BODY) == {
        "metadata": "", "metadata/ort.titles": "metadata", "sections/0": "", "sections/0/children/0": "sections/0", "sections/0/children/0/items/0": "sections/0/children/0",
        "sections/0/children/0/items/1/0": "sections/0/children/0", "sections/0/children/0/items/1/2": "sections/0/children/0", "sections/1": "", "sections/2/0": "", "sections/2/0/links/0": "sections/2/0",
        "sections/3": "", "sections/3/content": "sections/3", "sections/3/content/text/0": "sections/3/content",
    }
    assert addresses({"sections": {"title": "x", "items": "attribute"}, "metadata": []}) == {"sections": ""}
    assert addresses({}) == addresses({"sections": None}) == addresses({"sections": "text"}) == {}


def test_intervals_nest():
    nodes = label_nodes(BODY)
    assert sorted(x for n in nodes for x in n[1:3]) == list(range(2 * len(nodes)))
    for n in nodes:
        around = [m for m in nodes if m[1] < n[1] and n[2] < m[2]]
        assert len(around) == n[3] and (max(m[1] for m in around) if around else -1) == n[4]


def test_bodies():
    text = json.dumps(BODY)
    for body in (text, "﻿" + text, json.dumps(text), "﻿" + json.dumps("﻿" + text), f"\n {text} "):
        assert whole_object(body) == BODY
    for body in (None, "", "null", "[1]", '"x"', text[:-1], text + "x", "not found", json.dumps(json.dumps(text)), '{"a": NaN}'):
        assert whole_object(body) is None


def test_reader_without_recursion():
    for value in (BODY, [], {}, [1, -2.5e3, True, None, "a\"b\\u00e9"], {"a": {"b": []}, "c": [[], {}]}, "x"):
        assert _deep_loads(json.dumps(value)) == value
    for text in ("", "{", "[1,]", "{,}", '{"a" 1}', '{"a":}', "[1 2]", "1 2", "]", '{"a":1,}', '["a]', "{1:2}"):
        try:
            _deep_loads(text)
        except ValueError:
            continue
        raise AssertionError(text)
    deep = 3_000
    body = '{"sections": ' + '[{"children": ' * deep + "[]" + "}]" * deep + "}"
    assert len(label_nodes(whole_object(body))) == deep


def test_tables(spark):
    rows = [(1, json.dumps(BODY), "x", 1), (2, None, "x", 1), (3, "{broken", "x", 1), (None, json.dumps(BODY), "x", 1), (4, json.dumps({"sections": ["w" * 300_000]}), "x", 1), (5, "{}", "x", 1)]
    nodes = node_table(spark.createDataFrame(rows, KIND))
    assert {(r.raw_id, r.node_address): r.parent_address for r in nodes.collect()} == {(1, a): p for a, p in addresses(BODY).items()} | {(4, "sections/0"): ""}
    tables = type_tables(nodes)
    assert tables["links"].select("node_address", "content", "attributes").collect()[0][1:] == ("l", '{"href": "h"}')
    assert {tuple(r) for r in contained(tables["sections"], tables["items"]).collect()} == {(1, "sections/0", f"sections/0/children/0/items/{k}") for k in ("0", "1/0", "1/2")}
    assert node_table(spark.createDataFrame([], KIND)).count() == 0
