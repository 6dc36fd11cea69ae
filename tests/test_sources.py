import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import events
from docloom.sources import documents as D
from docloom.sources import sinks
from docloom.streaming.events import map_stream

RECORDS = {
    "root/task/b.json": {"metadata": {"ort.titles": {"en_title": "B"}, "ort.summaries": {"fr_summary": "Résumé"}, "dcterms.issued": "2020"}, "source": "s+o+u+r+ce", "sections": [{"heading": "H", "children": [{"text": "c", "links": [{"text": "l"}, "no"], "rows": [["r1", {"label": "r2"}]]}], "items": ["i"]}]},
    "root/a.json": {"metadata": {}, "sections": []},
    "root/task/z/c.json": {"metadata": {"ort.titles": "C"}, "sections": [["deep", ["er"]]]},
}


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name, record in RECORDS.items():
            z.writestr(name, "﻿" + json.dumps(record))
        z.writestr("../evil.json", "{}")
        z.writestr("root/readme.txt", "no")
    rows = D.procedure_zip(spark, str(tmp_path / "p.zip")).orderBy("document_id").collect()
    assert [(r.document_id, r.path, r.document_type, r.title) for r in rows] == [(0, "root/a.json", "", "a"), (1, "root/task/b.json", "task", "B"), (2, "root/task/z/c.json", "task", "C")]
    assert rows[1].text == "B Résumé H i c l r1 r2" and rows[1].summary == "Résumé" and rows[1].modified == "2020" and rows[1].source == "s o u r ce"
    assert rows[2].text == "C deep er"


def test_bodies(spark):
    raw = spark.createDataFrame([(1, "root/task/b.json", json.dumps(RECORDS["root/task/b.json"])), (2, "x", "{"), (3, None, "{}"), (4, "x", None)], "raw_id long, path string, body string")
    assert [(r.raw_id, r.title) for r in D.documents_from_bodies(raw).collect()] == [(1, "B")]


def test_dense_ids(spark):
    rows = D.dense_ids(spark.range(100).select((F.lit(99) - F.col("id")).alias("v")), "k", "v").collect()
    assert {r.k: r.v for r in rows} == {k: k for k in range(100)}


def test_verses_and_csv(spark, tmp_path):
    (tmp_path / "kjv.json").write_text(json.dumps({"1 Samuel 3:4": "t", "Genesis 1:1": "u", "Preface": "v"}))
    rows = D.verse_files(spark, str(tmp_path / "kjv.json")).collect()
    assert {(r.source, r.book, r.chapter, r.verse_number, r.text) for r in rows} == {("kjv", "1 Samuel", 3, 4, "t"), ("kjv", "Genesis", 1, 1, "u")}
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines ""q"""\n')
    assert D.csv(spark, str(tmp_path / "x.csv"), ("a", "b")).collect()[0][1] == 'two\nlines "q"'
    with pytest.raises(ValueError, match="c"):
        D.csv(spark, str(tmp_path / "x.csv"), ("c",))


def test_uploads(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>A</w:t><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:document>')
    b64 = lambda b: base64.b64encode(b).decode()
    rows = [("a.docx", None, b64(out.getvalue())), ("a.json", None, b64(b'{"text": "x", "other": "y", "title": ["z"]}')), ("a.TXT", None, b64(b"hi  there")), ("a.pdf", None, b64(b"x")), (None, "pasted", None), ("t", " ", None), ("t", None, "%%%"), ("a.docx", None, b64(b"no zip"))]
    made = D.uploads(spark.createDataFrame(rows, "filename string, text string, contentBase64 string")).collect()
    assert [r.document_text for r in made] == ["Ab\nc", "z\nx", "hi there", None, "pasted", None, None, None]
    assert [r.error is None for r in made] == [True, True, True, False, True, False, False, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "k int, v string")
    sinks.csv_report(df.orderBy("k"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith("﻿k,v\n1,".encode())
    with pytest.raises(ValueError):
        sinks.csv_report(df, str(tmp_path / "r.csv"), 1)
    sinks.json_report(df.orderBy("k"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["k"] == 1
    sinks.csv_folder(df, str(tmp_path / "folder"))
    assert D.csv(spark, str(tmp_path / "folder")).count() == 2
    links = spark.createDataFrame([("Duplicated", "A", "B", 2.0, 1.0, 0.2)], "relationship string, source_node string, target_node string, width double, source_angle double, target_angle double")
    arcs = spark.createDataFrame([("A", 1.5, 0.1), ("B", 0.0, -3.0)], "node string, start double, end double")
    sinks.html_report("T<>", links, arcs, df, str(tmp_path / "p.html"))
    page = (tmp_path / "p.html").read_text()
    assert "T&lt;&gt;" in page and page.count("<polyline") == 3


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(1, "The system rescinds D18."), (2, "Nothing.")], "doc_id int, text string").write.parquet(str(folder))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(folder))
    found = []
    map_stream(stream, lambda rows, k: found.extend(rows.select("doc_id", "event_type").collect()), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    assert [tuple(r) for r in found] == [(1, "PenaltyRescission")]
    assert events.SCHEMA_VERSION


def test_report_has_toggles_and_differences(spark, tmp_path):
    from docloom.sources import sinks

    links = spark.createDataFrame([("Dup<1>", "a", "b", 2.0, 0.1, 1.2)], "relationship string, source_node string, target_node string, width double, source_angle double, target_angle double")
    arcs = spark.createDataFrame([("a", 0.0, 1.0)], "node string, start double, end double")
    records = spark.createDataFrame([("pair-1", "a - b", "Dup<1>", "same old text", "same new text</script>", False, False)], "id string, label string, relationship string, sourceText string, targetText string, sourceTruncated boolean, targetTruncated boolean")
    sinks.html_report("T", links, arcs, records, str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert 'data-relationship="Dup&lt;1&gt;"' in page and 'id="toggles"' in page and 'id="search"' in page
    assert '{"op":"delete","token":"old"}' in page and '{"op":"insert","token":"new"}' in page and page.count("</script>") == 2
