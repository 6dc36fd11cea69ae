"""Visually identical text: the confusables skeleton, and groups of texts that share one.

A text is decomposed canonically, every character is replaced by the prototype of its look-alike
class, and the outcome is decomposed again.  Two texts that look the same have one skeleton.

Prototypes of letters come from the Unicode table of confusables, which the ICU library among Spark's
own jars carries: every letter and letter-like number outside ASCII that this table holds for the look
of an ASCII letter is replaced by that letter, in its own case where there is a choice.  Widths, spaces,
ligatures and what takes no room come from the character database.

Kept apart on purpose, as the eye tells them apart: letter case, accents, digits against letters,
superscripts against plain digits, the number of spaces, tabs and line breaks.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut, scratch

# The commonest letters of other scripts and the Latin letter each one looks like; they stand whatever the table says.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏҮүҺԌԚԜ", "ABESIJKMHOPCTYXaesijopcyxhdqwlYyhGQW", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "ABEZHIKMNOPTYXaivopu", strict=True))
OTHER = dict(zip("ɑɡıՕօհսԼᎪᎬᎳ", "agiOohuLAEW", strict=True))
# Dashes as long as a hyphen; characters that take no room though their category is not Cf.
HYPHENS = "‐‑‒–−˗﹘﹣－"
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0x180B, 0x180F)]))
#: Format characters that do show: signs that enclose numbers.
SHOWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
WORD = re.compile(r"[^\W_]+")


@cache
def common() -> dict[int, str | None]:
    """Code point -> prototype without the table of confusables: from the character database and the commonest letters."""
    table: dict[int, str | None] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            table[code] = " "
        elif kind == "Cf" and code not in SHOWN:
            table[code] = None
        elif (how := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")) or how.startswith("<compat>") and "LIGATURE" in unicodedata.name(c, ""):
            table[code] = "".join(chr(int(x, 16)) for x in how.split()[1:])
    table |= {ord(c): None for c in UNSEEN} | {ord(c): "-" for c in HYPHENS}
    table |= {ord(a): b for part in (CYRILLIC, GREEK, OTHER) for a, b in part.items()}
    return table


_MADE: dict[str, dict[int, str | None]] = {}


def prototypes(spark: SparkSession) -> dict[int, str | None]:
    """Code point -> prototype; None for what the eye does not see.  Made once per application, on the driver."""
    name = spark.sparkContext.applicationId
    if name not in _MADE:
        _MADE[name] = _confusable_letters(spark) | common()
    return _MADE[name]


def _confusable_letters(spark: SparkSession) -> dict[int, str]:
    """Letters outside ASCII that look like an ASCII letter, by one call to the table for all letters."""
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    codes = [k for k in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(k)) in ("Lu", "Ll", "Lt", "Lo", "Nl")]
    plain = [*map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)])]
    shapes = checker.getSkeleton("\n".join([*plain, *map(chr, codes)])).split("\n")
    looks: dict[str, list[str]] = {}
    for letter, shape in zip(plain, shapes, strict=False):
        looks.setdefault(shape, []).append(letter)
    out: dict[int, str] = {}
    capitals: dict[str, int] = {}  # by script, how many more of its letters look like capitals than like small ones
    for code, shape in zip(codes, shapes[len(plain) :], strict=True):
        if len(looks.get(shape, ())) == 1:
            script = unicodedata.name(chr(code), "").split(" ")[0]
            capitals[script] = capitals.get(script, 0) + (1 if looks[shape][0].isupper() else -1)
    for code, shape in zip(codes, shapes[len(plain) :], strict=True):
        c = chr(code)
        same = unicodedata.normalize("NFKC", c)
        if same in plain and not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
            out[code] = same  # a letter in another style
        elif shape in looks and not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
            upper = c.isupper() or not c.islower() and capitals.get(unicodedata.name(c, "").split(" ")[0], 0) > 0
            out[code] = next((x for x in looks[shape] if x.isupper() == upper), looks[shape][0])
    return out


def caseless(table: dict[int, str | None]) -> dict[int, str]:
    """Small letters whose capitals look Latin, for comparisons that ignore case."""
    lower = {ord(small): b.lower() for code, b in table.items() if b and b.isascii() and b.isalpha() and len(small := chr(code).lower()) == 1 and small != chr(code)}
    return {code: b for code, b in lower.items() if code not in table}


def skeleton(text: str, table: dict[int, str | None] | None = None) -> str:
    """The form under which texts that look the same are equal; ``''`` for empty text."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(common() if table is None else table))


def plain_words(text: str | None, tables: tuple[dict[int, str | None], dict[int, str]] | None = None) -> list[str]:
    """Words (runs of letters and digits) without regard to case, punctuation and look-alikes.

    ``tables`` are prototypes and the ``caseless`` letters made of them.
    """
    if not text:
        return []
    if not text.isascii():
        table, small = tables or (common(), _common_caseless())
        text = unicodedata.normalize("NFC", skeleton(text, table)).lower()
        return WORD.findall(text if text.isascii() else text.translate(small))
    return WORD.findall(text.lower())


@cache
def _common_caseless() -> dict[int, str]:
    return caseless(common())


def word_tables(spark: SparkSession):
    """The tables of ``plain_words``, sent to the workers: some ten thousand characters, whatever the data."""
    table = prototypes(spark)
    return spark.sparkContext.broadcast((table, caseless(table)))


def _short(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def skeleton_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, shape, stored): 128-bit digests of each text's skeleton and of its stored form.

    One pass, no text leaves the workers.  Null text counts as empty; null ids are kept out, since
    nothing could be said about them.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    sent = docs.sparkSession.sparkContext.broadcast(prototypes(docs.sparkSession))  # some ten thousand characters, whatever the data

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_short(skeleton(t, table)) for t in texts], pa.binary()), pa.array([*map(_short, texts)], pa.binary())], ["doc_id", "shape", "stored"])

    return rows.mapInArrow(keys, "doc_id long, shape binary, stored binary")


def look_alike_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, group_id, documents, variants): one row per document.

    ``group_id`` is the smallest id whose text looks the same, ``documents`` how many look the same,
    ``variants`` in how many stored forms.  An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        keys = cut(skeleton_keys(docs, id_column, text_column))
        # Two partial aggregations: copies fold before the shuffle, so a group that holds a third of all rows is a few rows.
        forms = keys.groupBy("shape", "stored").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        groups = forms.groupBy("shape").agg(F.min("first").alias("group_id"), F.sum("copies").alias("documents"), F.count("*").alias("variants"))
        return keep(keys.join(groups, "shape").select("doc_id", "group_id", "documents", "variants"))


def look_alike_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id_1, doc_id_2), smaller id first: documents with one skeleton and different stored texts.

    Stored forms are paired first, once per two forms of a shape; only then do documents join, so
    copies of one form never meet each other and the work is that of the result.
    """
    with scratch(docs.sparkSession) as keep:
        keys = cut(skeleton_keys(docs, id_column, text_column))  # two digests a row; texts are read once
        forms = keys.groupBy("shape", "stored").agg(F.count("*").alias("copies"))
        several = forms.groupBy("shape").agg(F.count("*").alias("variants")).where("variants > 1").select("shape")
        keys = keys.join(several, "shape", "left_semi").distinct()
        forms = keys.select("shape", "stored").distinct()
        two = forms.alias("a").join(forms.alias("b"), F.expr("a.shape = b.shape and a.stored < b.stored")).select("a.shape", F.col("a.stored").alias("one"), F.col("b.stored").alias("other"))
        left = two.join(keys.select("shape", F.col("stored").alias("one"), F.col("doc_id").alias("x")), ["shape", "one"])
        both = left.join(keys.select("shape", F.col("stored").alias("other"), F.col("doc_id").alias("y")), ["shape", "other"])
        return keep(both.select(F.least("x", "y").alias("doc_id_1"), F.greatest("x", "y").alias("doc_id_2")).where("doc_id_1 <> doc_id_2").distinct())
