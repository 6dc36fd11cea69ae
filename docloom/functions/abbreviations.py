"""Acronyms and their expansions, and number words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

# Acronyms that are always known, and those expanded only where a text defines them.
KNOWN = {
    "AI": "artificial intelligence", "NLP": "natural language processing", "DB": "database", "ETA": "estimated time of arrival", "API": "application programming interface",
    "CPU": "central processing unit", "RAM": "random access memory", "HTML": "hypertext markup language", "AR": "approval request", "DD": "Direct Deposit",
}
AMBIGUOUS = frozenset({"US", "IT", "PM", "MS", "IR"})
FORM_FIRST = r"\b([A-Z][a-zA-Z\s]+?)\s*\(([A-Z]{2,})\)"
ACRONYM_FIRST = r"\b([A-Z]{2,})\s*\(([A-Z][a-zA-Z\s]+?)\)"


def expand(text: str, known: dict[str, str] | None = None, ambiguous: frozenset[str] = AMBIGUOUS) -> tuple[str, dict[str, str]]:
    """The text with acronyms written out, and all expansions that held for it.

    Definitions in the text shrink to their full form and win over known ones.  Longer acronyms go
    first; an expansion is subject to those after it.
    """
    defined: dict[str, str] = {}
    for pattern, acronym, form in ((FORM_FIRST, 2, 1), (ACRONYM_FIRST, 1, 2)):

        def define(m: re.Match, acronym: int = acronym, form: int = form) -> str:
            defined[m[acronym]] = m[form].strip()
            return defined[m[acronym]]

        text = re.sub(pattern, define, text)
    held = {**(KNOWN if known is None else known), **defined}
    for name in sorted(held, key=len, reverse=True):
        if name in defined or name not in ambiguous:
            text = re.sub(rf"\b{re.escape(name)}\b", lambda _, full=held[name]: full, text)
    return text, held


def expand_column(text: Column, known: dict[str, str] | None = None, ambiguous: frozenset[str] = AMBIGUOUS) -> Column:
    """``expand`` over a column, in Arrow batches: struct(text, abbreviations); null stays null."""
    kind = StructType([StructField("text", StringType()), StructField("abbreviations", MapType(StringType(), StringType()))])

    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, None) if t is None else expand(t, known, ambiguous) for t in texts]
        return pd.DataFrame(done, columns=["text", "abbreviations"])

    return F.pandas_udf(run, kind)(text)


def definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, acronym, full_form) of ``Full Form (ACRONYM)`` definitions, natively."""
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(FORM_FIRST), 2).alias("acronym"), F.regexp_extract_all(F.col(text), F.lit(FORM_FIRST), 1).alias("full_form"))
    return df.select(key, F.explode(both).alias("d")).select(key, "d.acronym", F.trim("d.full_form").alias("full_form"))


_ONES = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
_NUMBER = re.compile(rf"\b(?:{'|'.join([*_ONES, *_TENS])})(?:(?:\s+and\s+|[\s-]+)(?:{'|'.join([*_ONES, *_TENS, *_SCALES])}))*\b", re.IGNORECASE)


def digits_for_words(text: str) -> str:
    """English number words written as digits: ``two hundred and five`` becomes ``205``."""

    def value(m: re.Match) -> str:
        total = part = 0
        for w in re.findall(r"[a-z]+", m[0].lower()):
            if w in _SCALES and w != "hundred":
                total, part = total + max(part, 1) * _SCALES[w], 0
            elif w == "hundred":
                part = max(part, 1) * 100
            elif w != "and":
                part += _ONES.get(w, 0) + _TENS.get(w, 0)
        return str(total + part)

    return _NUMBER.sub(value, text)


def digits_column(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(digits_for_words, na_action="ignore")

    return F.pandas_udf(run, StringType())(text)
