"""Sources: zipped procedure documents, verse files, CSV, uploads; read on the executors, no shuffle but for dense ids."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

DOCUMENT = "path string, document_type string, title string, summary string, language string, modified string, source string, text string"
#: Bytes of an upload at most.
MOST_BYTES = 15_000_000
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def clean(value: Any) -> str:
    """``text.clean_text`` for a single value."""
    if value is None:
        return ""
    t = html.unescape(str(value)).replace("\u00a0", " ")
    if t.count("+") > max(2, t.count(" ") // 2):
        t = t.replace("+", " ")
    return " ".join(t.split())


def section_texts(tree: Any) -> Iterator[str]:
    """The texts of a section tree in reading order: own texts first, then items, children, link texts, rows."""
    todo = [tree]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            if t := clean(value):
                yield t
        elif isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            below = [value[k] for k in ("heading", "title", "label", "text", "content") if k in value]
            for k in ("items", "children"):
                below += value.get(k) or [] if isinstance(value.get(k), list | None) else [value[k]]
            below += [link.get("text") for link in value.get("links") or [] if isinstance(link, dict)]
            below += value.get("rows") or [] if isinstance(value.get("rows"), list | None) else [value["rows"]]
            todo.extend(reversed(below))


def _first(*values: Any) -> str:
    return next((t for t in map(clean, values) if t), "")


def _lookup(value: Any, *keys: str) -> str:
    return _first(*(value.get(k) for k in keys)) if isinstance(value, dict) else _first(value)


def document_of(path: str, record: dict) -> tuple | None:
    """A document's fields in the order of DOCUMENT; None if it has no text at all."""
    meta = record.get("metadata") if isinstance(record.get("metadata"), dict) else {}
    title = _first(_lookup(meta.get("ort.titles"), "en_title"), meta.get("dcterms.title"), PurePosixPath(path).stem)
    summary = _lookup(meta.get("ort.summaries"), "en_summary", "fr_summary")
    parts = PurePosixPath(path).parts
    text = clean(" ".join(p for p in (title, summary, *section_texts(record.get("sections"))) if p))
    if not text:
        return None
    return path, parts[1] if len(parts) > 2 else "", title, summary, _first(meta.get("dcterms.language")), _first(meta.get("dcterms.modified"), meta.get("dcterms.issued")), _first(record.get("source")), text


def safe_members(archive: zipfile.ZipFile) -> list[str]:
    """Names in an archive that stay inside it when unpacked."""
    return sorted(n for n in archive.namelist() if not n.startswith(("/", "\\")) and ".." not in PurePosixPath(n.replace("\\", "/")).parts and not re.match(r"^[A-Za-z]:", n))


def procedure_zip(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one or more zips of JSON files: (document_id, path, ...), ids dense from 0 in path order.

    Documents without text are left out before ids are given.
    """
    return zipped_documents(spark.read.format("binaryFile").load(path).select("content"))


def zipped_documents(archives: DataFrame) -> DataFrame:
    """``procedure_zip`` for archives that are a column of bytes, (content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    read = ((n, json.loads(archive.read(n).decode("utf-8-sig"))) for n in safe_members(archive) if n.endswith(".json"))
                    rows = [document_of(n, record) for n, record in read if isinstance(record, dict)]
                yield pd.DataFrame([r for r in rows if r], columns=names)

    return dense_ids(archives.select("content").mapInPandas(run, DOCUMENT), "document_id", "path")


def dense_ids(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with ids 0, 1, ... in the order of some columns: sorted in parallel, counted per partition, offset."""
    from docloom.session import cut

    placed = cut(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = starts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    base = placed.join(F.broadcast(before), "_p")
    return base.select((F.col("_b") + F.col("_k") - F.shiftleft(F.col("_p").cast("long"), 33)).alias(name), *[c for c in rows.columns])


def documents_from_bodies(raw: DataFrame, id_column: str = "raw_id", path: str = "path", body: str = "body") -> DataFrame:
    """The same fields from a table of JSON bodies, (id, path, ...); damaged bodies give no row."""
    from docloom.operators.nested import whole_object

    kind = dict(raw.dtypes)[id_column]
    names = [id_column, *(c.split()[0] for c in DOCUMENT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *d) for i, p, b in batch.itertuples(index=False) if isinstance(b, str) and (r := whole_object(b)) is not None and (d := document_of(p or "", r))]
            clean_rows = [tuple(v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in r) for r in rows]
            yield pd.DataFrame(clean_rows, columns=names)

    return raw.select(id_column, path, body).mapInPandas(run, f"`{id_column}` {kind}, {DOCUMENT}")


def verse_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, book, chapter, verse_number, text) of files ``{"Book c:v": text}``; keys that do not parse are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    rows = files.select(X.path_stem("file").alias("source"), F.explode("m").alias("key", "text")).withColumn("v", X.verse_key("key"))
    return rows.where("v is not null").select("source", "v.book", "v.chapter", "v.verse_number", "text")


def csv(spark: SparkSession, path: str, columns: tuple[str, ...] = (), **options) -> DataFrame:
    """A CSV with header whose texts may hold line breaks and quotes; required columns are checked first."""
    from docloom.operators.graph import require_columns

    read = spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=True, encoding="UTF-8") if "schema" not in options else spark.read.schema(options.pop("schema")).options(header=True, multiLine=True, quote='"', escape='"')
    if columns:
        head = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)  # the header only
        require_columns(head, columns)
    return read.options(**options).csv(path)


def text_of_upload(name: str, content: bytes) -> str:
    """The text of a .docx, .json, .txt, .md or suffixless document; ValueError for others."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix == ".docx":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
        paragraphs = (["".join(t.text or "" for t in p.iter(f"{_WORD_NS}t"))] if p.find(f".//{_WORD_NS}t") is not None else [] for p in root.iter(f"{_WORD_NS}p"))
        return "\n".join(t for p in paragraphs for t in p)
    if suffix == ".json":
        return "\n".join(_json_texts(json.loads(content.decode("utf-8-sig"))))
    if suffix in (".txt", ".md", ""):
        return content.decode("utf-8-sig")
    raise ValueError("Supported formats: .txt, .md, .json, and .docx")


def _json_texts(value: Any) -> Iterator[str]:
    """All texts of a JSON tree; of an object its title, summary, text and content if it has any of them."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _json_texts(v)
    elif isinstance(value, dict):
        for v in [value[k] for k in ("title", "summary", "text", "content") if k in value] or [*value.values()]:
            yield from _json_texts(v)


def uploads(requests: DataFrame, name: str = "filename", text: str = "text", content: str = "contentBase64", most: int = MOST_BYTES) -> DataFrame:
    """Requests with ``document_text`` and ``error``: too large, not readable, blank or unsupported."""

    def run(names: pd.Series, texts: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for n, t, c in zip(names, texts, contents, strict=True):
            try:
                if c is not None and len(c) > most or t is not None and len(t) > most:
                    raise ValueError(f"Request exceeds {most} bytes")
                got = text_of_upload(n or "", bytes(c)) if c is not None else (t or "")
                if not got.strip():
                    raise ValueError("No text was found")
                out.append((got, None))
            except Exception as why:  # noqa: BLE001  a bad upload is a row's error
                out.append((None, str(why) or type(why).__name__))
        return pd.DataFrame(out, columns=["document_text", "error"])

    bytes_ = F.try_to_binary(F.col(content), F.lit("base64"))
    bad = F.col(content).isNotNull() & bytes_.isNull()
    made = requests.withColumn("_u", F.pandas_udf(run, "document_text string, error string")(name, text, bytes_))
    return made.withColumn("document_text", F.when(~bad, X.clean_lines("_u.document_text"))).withColumn("document_text", F.nullif("document_text", F.lit(""))).withColumn("error", F.when(bad, "contentBase64 is not base64").otherwise(F.col("_u.error"))).drop("_u")

