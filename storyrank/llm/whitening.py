"""Embedding whitening with components by FEAST contour integration.

Spark sums exact integers, then products of centred entries: a task holds one matrix of
dimension by dimension, whatever the rows, and ships it once. The eigenproblem is that
matrix's, so its size is the dimension's. Inertia counts cut the wanted part of the
spectrum into slices at gaps; each slice is a task that projects random vectors onto its
interval by quadrature of complex shifted solves, extracts the components by
Rayleigh-Ritz, and ends only when it holds as many as the inertia counts say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET = 1_000_000  # fixed value: added to every whole number
GRID = 64.0  # fixed value: steps of an entry to one
LARGEST = float(1 << 53)  # larger whole numbers are cut to this, so that they stay exact
NODES = 8  # quadrature nodes on the upper half circle
SLICE = 8  # components of a slice, if there are gaps to cut at
LEAST = 1e-10  # eigenvalues up to this share of the largest count as none
TIE = 1e-9  # eigenvalues nearer than this share of the largest stay in one slice
ROUNDS = 40


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``totals`` of the whole numbers (without the offset),
    eigenvalues ``values``, falling, their unit vectors as columns of ``vectors``."""

    n: int
    totals: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def usable(vec: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(vec, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _whole(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``floor(64 * c)`` of each entry as a matrix, missing entries as 0, and the lengths."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, dtype=np.int64)
    width = int(lengths.max(initial=0)) if dim is None else dim
    out = np.zeros((len(column), width), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width) < lengths[:, None]] = np.clip(np.floor(GRID * flat), -LARGEST, LARGEST).astype(np.int64)
    return out, lengths


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sums of the high and low halves and the vectors that reach it; the
    row -1 counts all vectors."""
    high, low, reach = (np.zeros(0, dtype=np.int64) for _ in range(3))
    n = 0
    for batch in batches:
        z, lengths = _whole(batch.column(0))
        n += len(z)
        if z.shape[1] > len(high):
            high, low, reach = (np.pad(a, (0, z.shape[1] - len(a))) for a in (high, low, reach))
        k = z.shape[1]
        high[:k] += (z >> 32).sum(axis=0)
        low[:k] += (z & 0xFFFFFFFF).sum(axis=0)
        reach[:k] += (np.arange(k) < lengths[:, None]).sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, len(high))), pa.array(np.append(0, high)), pa.array(np.append(0, low)), pa.array(np.append(n, reach))],
        names=["i", "high", "low", "reach"])


def _centred(z: np.ndarray, n: int, totals: tuple[int, ...]) -> np.ndarray:
    """Entries less their mean; the whole part of the mean goes off exactly, before the rest."""
    whole = np.array([t // n for t in totals], dtype=np.int64)
    rest = np.array([(t % n) / n for t in totals])
    return (z - whole).astype(np.float64) - rest


def _products(n: int, totals: tuple[int, ...], basis: np.ndarray | None = None):
    """Rows ``(i, row)`` of a task's sum of products of centred vectors, on ``basis`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _centred(_whole(batch.column(0), len(totals))[0], n, totals)
            y = y if basis is None else y @ basis
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(list(total))], names=["i", "row"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        rows = batch.column("row").flatten().to_numpy().reshape(len(batch), -1)
        for i, row in zip(batch.column("i").to_pylist(), rows, strict=True):
            total[i] = total[i] + row if i in total else row.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])


def _summed(vectors: DataFrame, size: int, products) -> np.ndarray:
    """The tasks' matrices added up, row by row in the cluster; ``size`` rows reach the driver."""
    parts = vectors.mapInArrow(products, "i long, row array<double>")
    added = parts.repartition(max(1, min(size, 64)), "i").mapInArrow(_add_rows, "i long, row array<double>")
    out = np.zeros((size, size))
    for r in added.collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


# --- inertia ---------------------------------------------------------------------
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix congruent to ``v``, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0.0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1:, k + 1:] @ x
        w = 2 * (p - x * (x @ p))
        a[k + 1:, k + 1:] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1, k] = -np.copysign(norm, a[k + 1, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    least = np.finfo(np.float64).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def slices(v: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)``: intervals with the ``components`` largest eigenvalues above the
    least one, cut where the spectrum has gaps, with the number of eigenvalues in each."""
    d = len(v)
    diagonal, off = tridiagonal(v)
    bound = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if bound == 0.0:
        return []
    low, high = np.full(d, -bound), np.full(d, bound * (1 + 1e-9))
    wanted = np.arange(d - 1, -1, -1)  # eigenvalue number i from the top has that many below
    for _ in range(40):  # places of the eigenvalues to a trillionth of the bound
        middle = (low + high) / 2
        over = inertia(diagonal, off, middle) > wanted
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    place = (low + high) / 2
    take = min(components, int((place > LEAST * place[0]).sum()))
    if place[0] <= 0 or not take:
        return []
    gap = np.append(place[:-1] - place[1:], np.inf)  # behind each eigenvalue
    cuts, start = [], 0
    while start < take:
        first = start + (take - start if take - start <= SLICE else SLICE // 2) - 1
        reach = min(d, first + SLICE)
        if gap[first:reach].max() < TIE * place[0]:
            reach = d
        near = gap[first:reach]
        cut = first + int(np.argmax(near >= max(TIE * place[0], near[np.isfinite(near)].max(initial=0.0) / 4)))
        cuts.append(cut + 1)
        start = cut + 1
    edges = [bound * (1 + 1e-6)] + [(place[c - 1] + place[c]) / 2 if c < d else place[-1] - 0.5 * max(abs(place[-1]), LEAST * bound) for c in cuts]
    edges[0] = min(edges[0], place[0] + max(place[0] - edges[1], 1e-9 * bound))
    below = inertia(diagonal, off, np.array(edges))
    return [(float(edges[i + 1]), float(edges[i]), int(below[i] - below[i + 1])) for i in range(len(cuts)) if below[i] > below[i + 1]]


# --- FEAST -----------------------------------------------------------------------
def contour(v: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """``y`` projected onto the eigenvectors of the interval: complex shifted solves at Gauss
    nodes of the upper half circle; the lower half is their conjugate."""
    x, weights = np.polynomial.legendre.leggauss(NODES)
    radius, centre = (high - low) / 2, (high + low) / 2
    out = np.zeros_like(y)
    for angle, weight in zip(np.pi / 2 * (x + 1), weights, strict=True):
        arm = radius * np.exp(1j * angle)
        out += weight / 2 * (arm * np.linalg.solve((centre + arm) * np.eye(len(v)) - v, y)).real
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues inside the interval and their unit vectors (columns)."""
    d = len(v)
    room = min(d, 2 * count + 8)
    while True:
        x = np.random.default_rng(seed).standard_normal((d, room))
        best, found = np.inf, None
        for _ in range(ROUNDS):
            q = np.linalg.qr(contour(v, low, high, x))[0]
            values, turn = np.linalg.eigh(q.T @ v @ q)
            x = q @ turn
            error = np.linalg.norm(v @ x - x * values, axis=0)
            good = (low < values) & (values < high) & (error <= 1e-4 * (high - low))
            if good.sum() != count:
                continue
            worst = error[good].max()
            if worst >= best / 2:  # no longer better: as exact as rounding lets it be
                break
            best, found = worst, (values[good], x[:, good])
        if found is not None:
            return found
        if room == d:
            raise ArithmeticError(f"{count} eigenvalues counted between {low} and {high}, not all of them found")
        room = min(d, 2 * room)


def _solve(v: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*[batch.column(c).to_pylist() for c in ("low", "high", "count")], strict=True):
                values, vectors = feast(v, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    return run


def components_of(spark, v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit vectors (columns); each slice is a task."""
    cut = slices(v, components)
    if not cut:
        return np.empty(0), np.empty((len(v), 0))
    work = spark.createDataFrame(cut, "low double, high double, count long").repartition(len(cut), "low")
    rows = work.mapInArrow(_solve(v), "value double, vector array<double>").collect()
    if len(rows) != sum(c for _, _, c in cut):
        raise ArithmeticError("the slices do not hold what the inertia counts say")
    basis = np.linalg.qr(np.array([r["vector"] for r in sorted(rows, key=lambda r: -r["value"])]).T)[0]
    values, turn = np.linalg.eigh(basis.T @ v @ basis)  # across slices
    order = np.argsort(-values)[:components]
    return values[order], (basis @ turn)[:, order]


def fit(vectors: DataFrame, components: int = 32, vec_col: str = "embedding") -> Whitening:
    """Sums, covariance and components of all usable vectors.

    A shorter vector has entries 0 where others go on. There are fewer components than asked
    for if the dimension or the rank (eigenvalues above ``LEAST`` of the largest) is lower.
    """
    rows = vectors.filter(usable(F.col(vec_col))).select(F.col(vec_col).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(_totals, "i long, high long, low long, reach long")
    sums = {r["i"]: r for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("high", "low", "reach")]).collect()}
    n = sums[-1]["reach"] if sums else 0
    totals = tuple((sums[i]["high"] << 32) + sums[i]["low"] for i in range(len(sums) - 1))
    if not n or not totals:
        return Whitening(n, totals, np.empty(0), np.empty((len(totals), 0)), 0.0)
    v = _summed(rows, len(totals), _products(n, totals)) / n
    values, found = components_of(vectors.sparkSession, v, components)
    return Whitening(n, totals, values, found, float(np.trace(v)))


def _deviations(z: np.ndarray, n: int, totals: tuple[int, ...]) -> list[int | None]:
    """Sum of ``(n * x - S)^2`` in whole numbers; none if a long cannot hold it."""
    whole = np.array([t // n for t in totals], dtype=np.int64)
    rest = np.array([t % n for t in totals], dtype=np.int64)
    y = z - whole
    size = np.abs(y).astype(np.float64) * n + n
    small = (size * size).sum(axis=1) < float(1 << 62)
    out = np.zeros(len(z), dtype=object)
    away = n * y[small] - rest
    out[small] = (away * away).sum(axis=1)
    for i in np.flatnonzero(~small):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[i], rest, strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return out.tolist()


def _project(model: Whitening):
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _whole(batch.column("v"), len(model.totals))[0]
            y = _centred(z, model.n, model.totals) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(_deviations(z, model.n, model.totals), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))],
                names=["id", "deviation", "whitened"])

    return run


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id_col, deviation, whitened)`` for each usable vector, null and repeated ids too.

    ``deviation`` is exact, null where a long cannot hold it; ``whitened`` has an entry for
    each component, so none if all vectors are equal. No usable vector, no rows.
    """
    rows = vectors.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("deviation", T.LongType()),
                         T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if not model.n:
        return vectors.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_col)
    return rows.mapInArrow(_project(model), kind).withColumnRenamed("id", id_col)


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance less the identity, summed over all rows."""
    k = len(model.values)
    if not k:
        return 0.0
    rows = vectors.filter(usable(F.col(vec_col))).select(F.col(vec_col).cast("array<double>").alias("v"))
    covariance = _summed(rows, k, _products(model.n, model.totals, model.vectors / np.sqrt(model.values))) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def report(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component, numbered from 1 by falling eigenvalue, with
    ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    vectors = vectors.select(id_col, vec_col)
    model = fit(vectors, components, vec_col)
    error = identity_error(vectors, model, vec_col)
    shares = F.array(*[F.lit(float(s)) for s in model.explained]).cast("array<double>")
    rows = transform(vectors, model, id_col, vec_col).select(
        id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
