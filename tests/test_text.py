import html

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import abbreviations, diff, vectorize
from docloom.functions import text as X
from docloom.functions.moments import moment, path_root
from docloom.plans import fixtures
from docloom.sources.documents import clean


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def many(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", column(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_clean_text(spark):
    values = [None, "", " a  b ", "a+b+c+d", "a+b c", "&eacute;&amp;&#39;", "x y\t\nz", "+ + + + a", "1 + 2 = 3"]
    assert many(spark, X.clean_text, values) == [clean(v) for v in values]
    assert many(spark, X.clean_lines, ["a \t b\n\n\n\nc ", None]) == ["a b\n\nc", ""]
    df = spark.createDataFrame([(" ", "+", "x")], "a string, b string, c string")
    assert df.select(X.first_string("a", "b", "c")).first()[0] == "+"


def test_relationship_heuristics(spark):
    long = "word " * 50
    cases = [("A b!", "a  B", 0.1, "semantically_identical"), ("", None, 0.1, "semantically_identical"), (long, long + "more", 0.1, "one_doc_included"), ("a b", "a b c", 0.5, "candidate"), ("x", "y", 0.85, "semantically_identical"), ("x", "y", 0.65, "possible_duplicate"), ("x", "y", 0.6499, "candidate")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string, s double, want string").select("want", X.heuristic_relationship(F.col("a"), F.col("b"), F.col("s"))["type"].alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_previews(spark):
    for text in ("", "short", "x" * 900, "y" * 899 + " tail", "<a & 'b'> " * 30):
        compact = " ".join(text.split())
        want = compact if len(compact) <= 900 else compact[:899].rstrip() + "..."
        assert one(spark, X.preview, text) == want
        assert one(spark, X.html_lines, text) == ("<br>".join(html.escape(want[k : k + 96]) for k in range(0, len(want), 96)) or "No text available")
    c = one(spark, lambda v: X.clipped(v, 5), "abcd  efg")
    assert (c.text, c.truncated) == ("abcd", True)


def test_small_functions(spark):
    assert many(spark, X.relationship_name, ["one_doc_included\n", "parse_error", "", None]) == ["Partial inclusion", "parse_error", "Other", "Other"]
    assert many(spark, X.is_skipped, [" skipped_limit", None, "x"]) == [True, False, False]
    assert many(spark, X.path_stem, ["a/b/c.d.json", "x", ".json", "a\\b.txt"]) == ["c.d", "x", ".json", "b"]
    assert many(spark, X.optional_int, ["none", " NULL", "", "42", "x", None]) == [None, None, None, 42, None, None]
    assert many(spark, X.plain_definition, ["<def>A <b>frame</b>\n x</def>", None]) == ["A frame x", ""]
    assert abs(one(spark, X.sigmoid, 0.0, "double") - 0.5) < 1e-12
    assert one(spark, lambda v: X.json_text(v, "double"), float("nan"), "double") == ""
    assert one(spark, X.script_safe, "</x>") == "\\u003c/x>"
    forms = spark.createDataFrame([("impose", "v"), ("apply", "v"), ("reward", "v"), ("class", "n"), ("give up", "v"), ("fast", "a")], "l string, p string").select(X.surface_forms(F.col("l"), F.col("p")).alias("f")).collect()
    assert [set(r.f) for r in forms] == [{"impose", "imposed", "imposes", "imposing"}, {"apply", "applied", "applies", "applying"}, {"reward", "rewarded", "rewards", "rewarding", "rewardes"}, {"class", "classes"}, {"give up"}, {"fast"}]


def test_sentences(spark):
    text = "One. two. Three!  Four?\n\nFive. Été fini. No"
    rows = X.sentences(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "id int, text string"), ["id"], "text").collect()
    assert [(r.id, r.sentence_index, r.sentence) for r in rows] == [(1, 0, "One. two."), (1, 1, "Three!"), (1, 2, "Four?"), (1, 3, "Five. Été fini."), (1, 4, "No")]


def test_model_replies(spark):
    rows = spark.createDataFrame(fixtures.REPLIES, "id int, reply string").select("id", X.model_reply("reply").alias("r")).collect()
    assert [r.r.relationship_type for r in sorted(rows)] == ["one_doc_included", "none_of_above", "parse_error", "parse_error", "parse_error"]


def test_moments(spark):
    cases = {
        "2020-02-29": "2020-02-29 00:00:00", " 2018-12-27+15:33:10 ": "2018-12-27 15:33:10", "2022-04-02T10:13:35-04:00": "2022-04-02 14:13:35", "2015-10-31T20:55:13Z": "2015-10-31 20:55:13", "2019/01/22": "2019-01-22 00:00:00",
        "17.10.2016": "2016-10-17 00:00:00", "August 5, 2018": "2018-08-05 00:00:00", "1 août 2021": "2021-08-01 00:00:00", "04-Sep-2021": "2021-09-04 00:00:00", "20170725": "2017-07-25 00:00:00", "1511150302": "2017-11-20 03:58:22", "1461641914000": "2016-04-26 03:38:34",
        "2021-02-30": None, "20211301": None, "soon": None, "": None, "n/a": None, "123": None, "2020-13-01": None, "1.5": None,
    }
    assert many(spark, lambda v: moment(v).cast("string"), list(cases)) == list(cases.values())
    paths = {"procedure%2Ftask%2Fx": "procedure", "./Desk_copy//a": "desk_copy", " scratch\\b": "scratch", "//a/b": "a", "": "", None: None, "a+b/c": "a+b"}
    assert many(spark, path_root, list(paths)) == list(paths.values())


def test_acronyms(spark):
    want = {
        1: "Our artificial intelligence group stores every natural language processing model in one database, with an estimated time of arrival for each.",
        2: "Staff file a Request For Comment first. Each Staff file a Request For Comment names its application programming interface.",
        3: "Each node has one Graphics Processing Unit and little random access memory.",
        4: "Ask the PM whether IT in the US sends the estimated time of arrival. Payments go by Delayed Debit since May.",
        5: None,
    }
    rows = spark.createDataFrame(fixtures.ACRONYMS, "id int, text string").select("id", abbreviations.expand_column(F.col("text"))["text"].alias("t")).collect()
    assert {r.id: r.t for r in rows} == want


def test_number_words():
    for words, digits in (("two hundred and five pages", "205 pages"), ("Twenty-one", "21"), ("one thousand two hundred", "1200"), ("no number", "no number"), ("and one", "and 1"), ("someone", "someone")):
        assert abbreviations.digits_for_words(words) == digits


def test_terms(spark):
    got = one(spark, lambda v: vectorize.terms(v, ("the",), True), "The été_1 a b2 the cc")
    assert got == ["été_1", "b2", "cc", "été_1 b2", "b2 cc"]
    assert one(spark, lambda v: vectorize.terms(v, (), True), None) == []


def test_tfidf_weights_have_length_one(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb cc dd"), (3, "cc dd dd"), (4, None)], "id int, text string")
    rows = vectorize.tfidf(docs, "id", "text", max_df=1.0).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.id for r in rows} == {1, 2, 3} and all(abs(r.n - 1) < 1e-9 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text("ab ,é_\n", max_size=30), st.text("ab ,é_\n", max_size=30))
def test_diffs_rebuild_both_sides(a, b):
    left, right, cut = diff.token_diff(a, b)
    assert "".join(t for _, t in left) == a and "".join(t for _, t in right) == b and not cut
    assert [t for o, t in left if o == "same"] == [t for o, t in right if o == "same"]


def test_diff_prefers_insertions():
    left, right, _ = diff.token_diff("a b", "a c b")
    assert left == [("same", "a"), ("same", " "), ("same", "b")] and [o for o, _ in right] == ["same", "insert", "insert", "same", "same"] or [o for o, _ in right].count("insert") == 2
    assert diff.token_diff("x " * 10, "y", 4)[2] is True


def test_diff_compares_whole_texts():
    a = [f"w{k}" for k in range(4_000)]
    left, right, cut = diff.token_diff(" ".join(a), " ".join([*a[:3_900], "new", *a[3_900:]]))
    assert not cut and len(left) == 7_999 and all(o == "same" for o, _ in left)
    for long in ("x y " * 100_000, " ".join(map(str, range(100_000)))):  # equal texts need no table
        assert all(o == "same" for side in diff.token_diff(long, long)[:2] for o, _ in side)
    assert [t for o, t in right if o == "insert"].count("new") == 1 and "".join(t for _, t in right).endswith("w3999")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_diff_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    left, _, _ = diff.token_diff("?".join(a), "?".join(b))
    words = sum(o == "same" for o, _ in diff.token_diff("".join(f"{x} " for x in a), "".join(f"{x} " for x in b))[0])
    assert sum(o == "same" for o, _ in left) >= table[-1][-1] and words >= table[-1][-1]
