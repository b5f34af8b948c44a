"""Whitening against a plain numpy version, and the spectral splits against known spectra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MIDDLE, SMALL
from wayfare.llm import queries as registered
from wayfare.llm import whitening


def plain(vectors, count=8):
    """n, exact deviations, whitened (components in columns), explained shares."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    return n, deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_whitening_matches_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).orderBy("vec_id").collect()
    n, deviation, white, explained = plain([r.e for r in rows])
    got = {(r.vec_id, r.component): r for r in registered.op12_embedding_whitening(spark, sf_dir).collect()}
    assert len(got) == 8 * n and all(r.n == n for r in got.values())
    for k in range(8):
        own = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        assert np.abs(own * np.sign(own @ white[:, k]) - white[:, k]).max() < 1e-9
        assert abs(got[rows[0].vec_id, k + 1].explained / explained[k] - 1) < 1e-10
    assert [got[r.vec_id, 1].deviation for r in rows] == deviation
    error = {r.identity_error for r in got.values()}
    assert len(error) == 1 and error.pop() < 1e-9


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [1e6, 1, 1e-6], [2, 2, 2, 1, 1], [3, 3, 3], [0, 0, 7], [0, 0, 0], [1 + 1e-12, 1, 0.5], [9], list(range(1, 65)), [1.0 + k / 300 for k in range(64)]])
def test_components_have_the_spectrum(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.RandomState(d).normal(size=(d, d)))
    a = q @ np.diag(np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a)
    top = max(spectrum) or 1
    assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * top


def test_a_projector_splits_at_the_shift():
    a = np.diag([4.0, 3.0, -1.0, -2.0])
    assert np.allclose(whitening.polar(a), np.diag([1, 1, -1, -1]), atol=1e-14)


def test_odd_vectors(spark):
    rng = np.random.RandomState(2)
    fine = [(k, [float(v) for v in rng.normal(size=3)]) for k in range(20)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    again = [fine[0], (None, fine[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in fine + odd + again], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).collect()
    kept = [*fine, *again]
    n, deviation, white, explained = plain([v for _, v in kept], 3)
    assert sorted({r.vec_id for r in got}, key=str) == sorted({i for i, _ in kept}, key=str) and len(got) == 3 * n
    by = {(r.vec_id, r.component): r for r in got}
    assert all(by[i, 1].deviation == d for (i, _), d in zip(kept, deviation, strict=True))
    for k in range(3):
        own = np.array([by[i, k + 1].whitened for i, _ in kept])
        assert np.abs(own * np.sign(own @ white[:, k]) - white[:, k]).max() < 1e-10
    assert got[0].identity_error < 1e-10


def test_vectors_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], schema)).orderBy("vec_id", "component").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and abs(line[0].explained - 1) < 1e-12 and line[0].identity_error < 1e-12
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(k, [float(2**38 * (k % 2)), 0.0]) for k in range(1000)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).select("deviation").distinct().collect()
    assert [r.deviation for r in got] == [None]
