"""Token differences of two texts by their longest common subsequence."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

TOKEN = regex.compile(r"\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+")


def _lengths(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Lengths of common subsequences of all prefixes, from the row ``first`` on; a row at a time, each a running maximum."""
    row = first
    yield row
    for t in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == t, row[:-1] + 1, 0)))
        row = new
        yield row


def token_diff(left: str | None, right: str | None, most: int | None = None) -> tuple[list[tuple[str, str]], list[tuple[str, str]], bool]:
    """(op, token) lists of both sides - ``same``, ``delete`` on the left, ``insert`` on the right - and whether tokens were cut.

    All tokens are compared, unless ``most`` names how many of a side are.  Every ``step``-th row of the table of lengths
    is kept and the rows between two are made again on the way back, so memory grows with tokens ** 1.5, not their square.
    A common end is the same on both sides before any table is made.
    """
    x, y = TOKEN.findall(left or ""), TOKEN.findall(right or "")
    cut = most is not None and max(len(x), len(y)) > most
    x, y = x[:most], y[:most]
    names = {t: k for k, t in enumerate(dict.fromkeys([*x, *y]))}
    a, b = (np.array([names[t] for t in side], np.int64) for side in (x, y))
    least = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - least :] != b[len(b) - least :])
    ending = least - 1 - int(apart[-1]) if len(apart) else least
    a, b = a[: len(a) - ending], b[: len(b) - ending]
    step = isqrt(len(a)) + 1
    kept = [row for k, row in enumerate(_lengths(a, b, np.zeros(len(b) + 1, np.int32))) if k % step == 0]
    start, table = len(a) + 1, []  # rows of the table from ``start`` on
    out: tuple[list, list] = ([], [])
    out[0].extend(("same", t) for t in x[len(a) :][::-1])
    out[1].extend(("same", t) for t in y[len(b) :][::-1])
    i, j = len(a), len(b)
    while i or j:
        if i and i - 1 < start:
            start = (i - 1) // step * step
            table = [*_lengths(a[start:i], b[:j], kept[start // step][: j + 1])]
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out[0].append(("same", x[i]))
            out[1].append(("same", y[j]))
        elif j and (not i or table[i - start][j - 1] >= table[i - 1 - start][j]):
            j -= 1
            out[1].append(("insert", y[j]))
        else:
            i -= 1
            out[0].append(("delete", x[i]))
    return out[0][::-1], out[1][::-1], cut


def diff_column(left: Column, right: Column, most: int | None = None) -> Column:
    """struct(left, right, truncated) in Arrow batches."""
    side = ArrayType(StructType([StructField("op", StringType()), StructField("token", StringType())]))
    kind = StructType([StructField("left", side), StructField("right", side), StructField("truncated", BooleanType())])

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        named = lambda pairs: [{"op": o, "token": t} for o, t in pairs]
        rows = [token_diff(p, q, most) for p, q in zip(a, b, strict=True)]
        return pd.DataFrame({"left": [named(r[0]) for r in rows], "right": [named(r[1]) for r in rows], "truncated": [r[2] for r in rows]})

    return F.pandas_udf(run, kind)(left, right)
