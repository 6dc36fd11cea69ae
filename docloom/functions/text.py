"""Text functions as native column expressions; Python only where noted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.entities import unescape

# Preview and diff lengths, hover line length.
PREVIEW_CHARS, LINE_CHARS, DIFF_CHARS = 900, 96, 20_000
# Relationship labels by code, in the order they are shown.
RELATIONSHIPS = {"semantically_identical": "Duplicated", "one_doc_included": "Partial inclusion", "conflict_in_information": "Contradiction", "none_of_above": "Unrelated"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(text: Column) -> Column:
    """Whitespace runs (Unicode, the non-breaking space too) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column | str) -> Column:
    """Entities resolved, ``+`` read as a blank where it stands for one, whitespace squeezed; null becomes ''."""
    t = F.replace(F.coalesce(unescape(_col(text)), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    encoded = count("+") > F.greatest(F.lit(2), F.floor(count(" ") / 2))
    return squeeze(F.when(encoded, F.replace(t, F.lit("+"), F.lit(" "))).otherwise(t))


def clean_lines(text: Column | str) -> Column:
    """As ``clean_text`` for text whose line breaks matter: blanks and tabs squeezed, three breaks or more become two."""
    t = F.replace(F.coalesce(unescape(_col(text)), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def first_string(*values: Column | str) -> Column:
    """The first value that is not empty once cleaned; '' if none is."""
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values], F.lit(""))


def join_filled(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def path_stem(path: Column | str) -> Column:
    """The last part of a path without its last suffix."""
    name = F.element_at(F.split(_col(path), "[/\\\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def type_of_path(path: Column | str) -> Column:
    """The second part of a path of three parts or more, else ''."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 2, parts[1]).otherwise("")


def normalized(text: Column | str) -> Column:
    """Small letters a-z and digits, everything else one blank: the form in which inclusion is judged."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "))


def heuristic_relationship(text1: Column, text2: Column, similarity: Column) -> Column:
    """struct(type, analysis) of a pair by equality, inclusion and similarity, in that order."""
    a, b = normalized(text1), normalized(text2)
    made = lambda kind, why: F.struct(F.lit(kind).alias("type"), F.lit(why).alias("analysis"))
    return (
        F.when(a == b, made("semantically_identical", "The normalized document text is exactly the same."))
        .when((F.length(a) > 200) & (F.length(b) > 200) & (F.contains(a, b) | F.contains(b, a)), made("one_doc_included", "One normalized document text is contained in the other."))
        .when(similarity >= 0.85, made("semantically_identical", "Very high TF-IDF cosine similarity; review recommended."))
        .when(similarity >= 0.65, made("possible_duplicate", "High TF-IDF cosine similarity; semantic review recommended."))
        .otherwise(made("candidate", "Above candidate threshold; needs semantic or SME review."))
    )


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_col(x).cast("double")))


def compact(text: Column | str) -> Column:
    """Whitespace squeezed; null becomes ''."""
    return squeeze(F.coalesce(_col(text).cast("string"), F.lit("")))


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def preview(text: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    """At most ``chars`` characters of the compact text; a cut one ends in three dots."""
    t = compact(text)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(_rstrip(F.left(t, F.lit(chars - 1))), F.lit("...")))


def html_escape(text: Column, quotes: bool = True) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def html_lines(text: Column | str, width: int = LINE_CHARS, chars: int = PREVIEW_CHARS) -> Column:
    """The preview in lines of ``width`` characters, escaped, joined by ``<br>``."""
    t = preview(text, chars)
    lines = F.transform(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{width}}}"), 0), lambda line: html_escape(line))  # the text is cut once, not per line
    return F.when(t == "", "No text available").otherwise(F.array_join(lines, "<br>"))


def clipped(text: Column | str, chars: int = DIFF_CHARS) -> Column:
    """struct(text, truncated): at most ``chars`` characters, and whether any were cut."""
    t = F.coalesce(_col(text).cast("string"), F.lit(""))
    long = F.length(t) > chars
    return F.struct(F.when(long, _rstrip(F.left(t, F.lit(chars)))).otherwise(t).alias("text"), long.alias("truncated"))


def strip(text: Column) -> Column:
    """Without whitespace of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def relationship_name(code: Column | str) -> Column:
    """The shown name of a relationship code; unknown codes stand for themselves, null and '' are 'Other'."""
    key = strip(F.coalesce(_col(code), F.lit("")))
    out = F.when(key == "", "Other")
    for raw, shown in RELATIONSHIPS.items():
        out = out.when(key == raw, shown)
    return out.otherwise(key)


def is_skipped(code: Column | str) -> Column:
    return F.startswith(F.upper(strip(F.coalesce(_col(code), F.lit("")))), F.lit("SKIPPED"))


def relationship_rank(name: Column | str) -> Column:
    out = F.lit(99)
    for rank, shown in reversed([*enumerate(RELATIONSHIPS.values())]):
        out = F.when(_col(name) == shown, rank).otherwise(out)
    return out


#: A sentence ends before whitespace that follows . ! ? and precedes a capital, or at line breaks.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])|\n+"


def sentences(df: DataFrame, key: Iterable[str], text: str) -> DataFrame:
    """(key..., sentence_index, sentence): the sentences that are not blank, counted from 0."""
    keys = [*key]
    parts = F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), SENTENCE_END), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    return df.select(*keys, F.posexplode(parts).alias("sentence_index", "sentence"))


def verse_key(key: Column | str) -> Column:
    """struct(book, chapter, verse_number) of keys such as ``1 Samuel 3:4``; null where it does not parse."""
    pattern = r"^(\d?\s*[a-zA-Z\s]+)\s(\d+):(\d+)"
    part = lambda k: F.regexp_extract(_col(key), pattern, k)
    return F.when(_col(key).rlike(pattern), F.struct(F.trim(part(1)).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse_number")))


def optional_int(text: Column | str) -> Column:
    """An integer; null for '', ``none`` and ``null``, and where it is none."""
    t = F.lower(F.trim(_col(text)))
    return F.when(t.isin("none", "null", ""), None).otherwise(t.try_cast("int"))


def json_text(value: Column | str, kind: str = "string") -> Column:
    """A value as text; null and NaN become ''."""
    v = _col(value)
    filled = F.when(F.isnan(v), None).otherwise(v) if kind in ("double", "float") else v
    return F.coalesce(filled.cast("string"), F.lit(""))


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def plain_definition(text: Column | str) -> Column:
    """Markup removed, whitespace squeezed."""
    return squeeze(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "</?[^>]+>", ""))


def model_reply(reply: Column | str, valid: Iterable[str] = tuple(RELATIONSHIPS)) -> Column:
    """struct(relationship_type, analysis) of a language model's reply.

    A code fence is taken off; what is no JSON object is ``parse_error`` with the reply as analysis; an
    unknown type is ``parse_error`` too, with the type named.
    """
    text = F.trim(_col(reply))
    fenced = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text))
    parsed = F.from_json(body, "map<string,string>")
    ok = F.startswith(body, F.lit("{")) & parsed.isNotNull()
    kind = F.trim(F.coalesce(F.try_element_at(parsed, F.lit("relationship_type")), F.lit("")))
    why = F.coalesce(F.try_element_at(parsed, F.lit("analysis")), F.lit(""))
    wrong = F.concat(F.lit("Invalid relationship_type from model: '"), F.when(ok, kind).otherwise("parse_error"), F.lit("'. Raw analysis: "), F.when(ok, why).otherwise(body))
    good = ok & kind.isin(*valid)
    return F.struct(F.when(good, kind).otherwise("parse_error").alias("relationship_type"), F.when(good, why).otherwise(wrong).alias("analysis"))


def surface_forms(lemma: Column, part_of_speech: Column) -> Column:
    """The forms a lexical unit can take in text: inflected verbs and plurals; units of several words as they are."""
    add = lambda *ends: F.array(lemma, *[F.concat(lemma, F.lit(e)) for e in ends])
    stem = F.left(lemma, F.length(lemma) - 1)
    verb = (
        F.when(F.endswith(lemma, F.lit("e")), F.array(lemma, F.concat(lemma, F.lit("d")), F.concat(lemma, F.lit("s")), F.concat(stem, F.lit("ing"))))
        .when(F.endswith(lemma, F.lit("y")), F.array(lemma, F.concat(stem, F.lit("ied")), F.concat(stem, F.lit("ies")), F.concat(lemma, F.lit("ing"))))
        .otherwise(add("ed", "s", "ing", "es"))
    )
    noun = F.when(lemma.rlike("(s|x|z|ch|sh)$"), add("es")).otherwise(add("s"))
    return F.when(F.contains(lemma, F.lit(" ")), F.array(lemma)).when(part_of_speech == "v", verb).when(part_of_speech == "n", noun).otherwise(F.array(lemma))
