"""Whitening against numpy's dense eigenvectors and whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from storyrank.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("n", T.StringType())])


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors):
    """Usable vectors, their whole numbers and the covariance, centred first."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in good), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for _, v in good]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    return [i for i, _ in good], x, n, sums, y


def made(seed, n, dim, rank=None):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, rank or dim)) @ rnd.standard_normal((rank or dim, dim))
    return [(i, [float(c) for c in row]) for i, row in enumerate(base)]


@pytest.mark.parametrize("dim", [1, 5, 40])
def test_report_equals_dense_eigenvectors(spark, dim):
    vectors = made(dim, 300, dim)
    vectors += [(300, None), (301, [None] * dim), (302, [float("nan")] * dim), (303, [float("inf")] * dim), (None, vectors[0][1]), (7, vectors[7][1])]
    ids, x, n, sums, y = brute(vectors)
    v = y.T @ y / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.report(frame(spark, vectors)).collect()
    k = min(32, dim)
    assert len(got) == n * k
    deviations = sorted(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == deviations
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    want = y @ basis[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        part = [r for r in got if r["component"] == c + 1]
        assert abs(part[0]["explained"] - values[c] / values.sum()) < 1e-12
        signs = {}
        for r in part:
            if r["vec_id"] is not None and r["vec_id"] != 7:
                mine = want[ids.index(r["vec_id"]), c]
                assert abs(abs(mine) - abs(r["whitened"])) < 1e-7
                if abs(mine) > 1e-6:
                    signs[np.sign(mine) * np.sign(r["whitened"])] = 1
        assert len(signs) == 1


def test_low_rank_ties_and_empty(spark):
    got = whitening.report(frame(spark, [(i, [float(i), 0.0, 0.0]) for i in range(20)])).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20
    square = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    tied = whitening.report(frame(spark, square)).collect()
    assert len(tied) == 8 and all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-9 for r in tied)
    assert whitening.report(frame(spark, [(1, [0.5, 0.25])] * 3)).count() == 0
    assert whitening.report(frame(spark, [(1, None)])).count() == 0
    assert whitening.report(frame(spark, []).limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_short_vectors_and_wide_values(spark):
    vectors = [(1, []), (2, [1.0]), (3, [1.0, -2.0]), (4, [3e38, 0.5]), (5, [-3e38, 0.25])]
    got = {r["vec_id"]: r for r in whitening.report(frame(spark, vectors)).filter("component = 1").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4]["deviation"] is None
    padded = [(1, []), (2, [1.0]), (3, [1.0, -2.0])]
    ids, x, n, sums, _ = brute(padded)
    got = {r["vec_id"]: r["deviation"] for r in whitening.report(frame(spark, padded)).filter("component = 1").collect()}
    assert got == {i: sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in zip(ids, x, strict=True)}


@pytest.mark.parametrize("spectrum", [np.repeat([9.0, 4, 1, 0.5], 16), np.ones(40), 10.0 ** -np.arange(30), np.append(np.ones(10), np.zeros(30))])
def test_feast_finds_what_inertia_counts(spectrum):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum), len(spectrum))))[0]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    cut = whitening.slices(v, 32)
    found = [whitening.feast(v, *s) for s in cut]
    values = np.sort(np.concatenate([f[0] for f in found]))[::-1]
    assert len(values) == sum(s[2] for s in cut) >= min(32, (spectrum > whitening.LEAST).sum())
    assert np.abs(values - np.sort(spectrum)[::-1][:len(values)]).max() < 1e-14 * len(spectrum)
    vectors = np.hstack([f[1] for f in found])
    assert np.abs(v @ vectors - vectors * np.concatenate([f[0] for f in found])).max() < 1e-13
