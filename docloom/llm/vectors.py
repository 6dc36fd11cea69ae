"""Usable vectors: one unit vector per id, from either of two columns; exact copies folded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

_LIST = re.compile(r"\s*\[\s*([^\[\]]*?)\s*\]\s*")


def parse(text: str | None) -> list[float] | None:
    """The numbers of ``[a, b, ...]`` (commas or blanks between them); None if it is no such list."""
    m = _LIST.fullmatch(text or "")
    if not m:
        return None
    try:
        return [float(x) for x in (m[1].split(",") if "," in m[1] else m[1].split())]
    except ValueError:
        return None


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be scaled to length one (all numbers finite, not all zero), and those rows scaled, in float32."""
    good = np.isfinite(values).all(1) & (values != 0).any(1) if len(values) else np.zeros(0, bool)
    values = values[good]
    values = values / np.abs(values).max(1, initial=0.0, keepdims=True)  # neither overflow nor underflow in the norm
    values = values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]
    return good, values.astype("<f4") + np.float32(0)  # no negative zero


def usable(rows: DataFrame, width: int = 64, id_column: str = "vec_id", array_column: str = "embedding", text_column: str | None = "embedding_str") -> DataFrame:
    """(vec_id, vec): unit vectors as little-endian float32 bytes, one row per id.

    The array column counts where it is not null, else the text column.  Vectors of another length,
    with nulls, infinities, NaN or only zeros are unusable.  Where one id has several usable rows, the
    smallest by bytes is taken, so that the choice does not depend on the order of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, texts = batch.column(1), batch.column(2)
            fits = arrays.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
            flat = arrays.filter(pa.array(fits)).flatten()  # a null among the numbers becomes NaN
            numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            at = np.flatnonzero(fits)
            told = np.flatnonzero(arrays.is_null().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False))
            read = [(k, v) for k, v in zip(told, map(parse, texts.take(pa.array(told)).to_pylist()), strict=True) if v is not None and len(v) == width]
            if read:
                at, numbers = np.concatenate([at, [k for k, _ in read]]), np.vstack([numbers, [v for _, v in read]])
            good, vecs = units(numbers)
            ids = batch.column(0).take(pa.array(at[good].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in vecs], pa.binary())], ["vec_id", "vec"])

    text = F.col(text_column) if text_column else F.lit(None)
    got = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(array_column).cast("array<double>").alias("a"), text.cast("string").alias("s")).where("vec_id is not null").mapInArrow(run, "vec_id long, vec binary")
    return got.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array | list, width: int) -> np.ndarray:
    """A column of such bytes as a float32 matrix."""
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), width)


def folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, rep) and representatives (rep, vec) of exactly equal unit vectors.

    ``rep`` is the smallest id.  Copies are found by 128-bit digests, so that vectors travel for the
    digests' sake not at all, and copies fold by partial aggregation before the shuffle.
    """
    vectors = cut(vectors)
    keys = vectors.selectExpr("vec_id", "xxhash64(vec) as k1", "xxhash64(vec, 7L) as k2")
    several = keys.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("k1", "k2", "rep")
    copies = cut(keys.join(several, ["k1", "k2"]).where("vec_id <> rep").select("vec_id", "rep"))
    members = vectors.select("vec_id").join(copies, "vec_id", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
    return members, vectors.join(copies.select("vec_id"), "vec_id", "left_anti").select(F.col("vec_id").alias("rep"), "vec")
