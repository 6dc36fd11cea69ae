from datetime import datetime

from pyspark.sql import functions as F

from docloom.llm.survivors import surviving_fields, surviving_records

KIND = "document_id long, text string, modified string, path string, loaded_at timestamp, group_id string, score int"
LOADED = datetime(2023, 1, 1)


def frames(spark, docs, groups):
    roots = spark.createDataFrame([("Procedure", 1), ("mirror", 2), (None, 3)], "root_name string, trust_rank int")
    return spark.createDataFrame([(*d, LOADED, "clash", 1) for d in docs], KIND), spark.createDataFrame(groups, "group_id string, document_id long"), roots


DOCS = [
    (1, "one two two", "2020-01-01", "mirror/a.json"),
    (2, "One &eacute;t&eacute; zwei", " 2021-05-06+07:08:09 ", None),
    (3, "a b c", "1672531200", "%50rocedure%2Fx.json"),
    (4, None, "2099-01-01", ".\\PROCEDURE\\y.json"),
    (5, "", "soon", "elsewhere/z.json"),
    (6, "!!", None, None),
    (7, "word " * 100_000, "6 août 2022", "//mirror//q"),
]
GROUPS = [("g", 1), ("g", 2), ("g", 3), ("g", 3), ("h", 4), ("h", 5), ("single", 1), ("single", 1), ("n", 6), ("n", 99), (None, 1), ("m", None), ("t", 7), ("t", 5)]


def test_fields(spark):
    found = {(r.group_id, r.field_name): r.document_id for r in surviving_fields(*frames(spark, DOCS, GROUPS)).collect()}
    # 3 words each for 2 and 3: the smaller id; 1672531200 is 2023-01-01, exactly the moment of loading.
    assert found == {("g", "text"): 2, ("g", "modified"): 3, ("g", "path"): 3, ("h", "path"): 4, ("t", "text"): 7, ("t", "modified"): 7, ("t", "path"): 7}


def test_records(spark):
    rows = {r.group_id: r for r in surviving_records(*frames(spark, DOCS, GROUPS)).collect()}
    assert rows["g"].path == "%50rocedure%2Fx.json" and rows["g"].text_from == 2
    assert rows["h"].text is None and rows["h"].modified is None


def test_empty(spark):
    docs, groups, roots = frames(spark, DOCS, GROUPS)
    assert surviving_fields(docs.limit(0), groups, roots).count() == 0
    assert surviving_fields(docs, groups.limit(0), roots).count() == 0
    assert {r.field_name for r in surviving_fields(docs, groups, roots.limit(0)).collect()} == {"text", "modified", "path"}


def test_repeated_documents_give_the_value_that_won(spark):
    docs = spark.createDataFrame([(1, "a b c", "2020-01-01", "x/1"), (1, "a b c d", "2021-01-01", "x/2"), (2, "a", "2019-01-01", "x/3")], "document_id long, text string, modified string, path string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = surviving_records(docs, spark.createDataFrame([("g", 1), ("g", 2)], "group_id string, document_id long"), spark.createDataFrame([("x", 1)], "root_name string, trust_rank int")).collect()
    assert [(r.text, r.modified, r.path) for r in got] == [("a b c d", "2021-01-01", "x/2")]
