"""Vector expressions: built-in forms for few rows, Arrow batches for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from storyrank.functions.text import _c


def _finite(x: Column) -> Column:
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad | x.isNull(), F.lit(0.0)).otherwise(x)


def _doubles(v) -> Column:
    return F.transform(_c(v).cast("array<double>"), _finite)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 for missing, empty, unequal or zero vectors; non-finite parts read as 0."""
    x, y = _doubles(a), _doubles(b)
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(x, y) / norms))
    usable = (F.size(x) > 0) & (F.size(x) == F.size(y)) & (norms > 0)
    return F.when(F.coalesce(usable, F.lit(False)), clipped).otherwise(F.lit(0.0))


def l2_normalize(v, dim: int | None = None) -> Column:
    """Unit vector, cut or zero-padded to ``dim``; a zero vector stays as it is."""
    x = _c(v).cast("array<double>")
    if dim is not None:
        x = F.slice(F.concat(x, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    norm = F.sqrt(_dot(x, x))
    return F.when(norm == 0, x).otherwise(F.transform(x, lambda e: e / norm))


def unit_rows(mat: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    norms[norms == 0.0] = 1.0
    return mat / norms


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each row's entries, and the entries, out of the list's own buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = column.values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return offsets[:-1], length, np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0)


@arrow_udf(T.DoubleType())
def cosine_bulk(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise cosine of two vector columns, computed on the flat buffers of a batch."""
    (at, n, x), (bt, m, y) = _list_parts(a), _list_parts(b)
    out = np.zeros(len(n))
    rows = np.flatnonzero((n == m) & (n > 0))
    if len(rows):
        size = n[rows]
        starts = size.cumsum() - size
        step = np.arange(size.sum()) - np.repeat(starts, size)
        u, v = x[np.repeat(at[rows], size) + step], y[np.repeat(bt[rows], size) + step]
        dot, uu, vv = (np.add.reduceat(p, starts) for p in (u * v, u * u, v * v))
        norms = np.sqrt(uu) * np.sqrt(vv)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[rows] = np.where(norms > 0, np.clip(dot / norms, -1.0, 1.0), 0.0)
    return pa.array(out, pa.float64())


def vector_sums(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Per-key position-wise weighted sum: ``(keys, total array<double>, weight_sum, n)``.

    A partial aggregate of dense vectors in the JVM: a map task ships one vector per key,
    so a hot key is never gathered. Vectors of several lengths under one key: the length
    that most of them have (ties: the longer) stands, the others are left out.
    """
    w = F.lit(1.0) if weight is None else weight
    src = df.filter(F.col(vec).isNotNull()).select(
        *keys, F.col(vec).cast("array<double>").alias("__v"), w.cast("double").alias("__w")
    )
    scaled = F.transform("__v", lambda x: F.coalesce(x, F.lit(0.0)) * F.col("__w"))
    by_length = src.withColumns({"__dim": F.size("__v"), "__x": array_to_vector(scaled)}).groupBy(*keys, "__dim").agg(
        Summarizer.sum(F.col("__x")).alias("__sum"), F.sum(F.abs("__w")).alias("weight_sum"), F.count(F.lit(1)).alias("n"))
    picked = by_length.groupBy(*keys).agg(
        F.max_by(F.struct("__sum", "weight_sum", "n"), F.struct("n", "__dim")).alias("__row"))
    if not keys:
        picked = picked.filter(F.col("__row").isNotNull())
    return picked.select(*keys, vector_to_array("__row.__sum").alias("total"), "__row.weight_sum", "__row.n")


def centroid(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """``(keys, centroid)``: mean of the non-null vectors, unit norm unless zero."""
    sums = vector_sums(df, keys, vec)
    mean = F.transform("total", lambda e: e / F.col("n"))
    return sums.select(*keys, l2_normalize(mean).alias("centroid"))
