"""Text to vectors by an encoder that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An encoder takes a list of texts and returns a row of numbers for each.
Encoder = Callable[[list[str]], np.ndarray]


def encode(text: Column, encoder: Encoder, batch: int = 64, unit: bool = True) -> Column:
    """The encoder's vector of each text (null counts as empty), ``batch`` texts at a time, scaled to length one if ``unit``.

    The encoder travels with the function; one that loads a model should do so at its first call.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [np.asarray(encoder(texts.iloc[a : a + batch].fillna("").to_list()), np.float32) for a in range(0, len(texts), batch)]
            made = np.concatenate(rows) if rows else np.zeros((0, 0), np.float32)
            if unit and len(made):
                length = np.linalg.norm(made.astype(np.float64), axis=1, keepdims=True)
                made = np.divide(made, length, out=np.zeros(made.shape), where=length > 0).astype(np.float32)
            yield pd.Series(list(made), dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


def letter_shares(texts: list[str]) -> np.ndarray:
    """An encoder without a model: how often each of the letters a to z stands in a text."""
    return np.array([[t.count(chr(97 + k)) for k in range(26)] for t in (x.lower() for x in texts)], np.float32).reshape(len(texts), 26)
