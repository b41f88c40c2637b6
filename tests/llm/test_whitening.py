"""Whitening against plain whole-number sums and a library's eigen-solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from brightwater.llm import whitening
from brightwater.llm.queries import op11_whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, components=8):
    """(n, deviations, whitened up to sign, explained) of equally long lists of numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(dim)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > values[0] * dim * 2.3e-16).sum())) if values[0] > 0 else 0
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x], centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def held(rows, ids, vectors, key="vec_id"):
    n, far, white, shares = plain(vectors)
    at = {(getattr(r, key), r.component): r for r in rows}
    assert len(rows) == len(at) == len(ids) * len(shares)
    for c in range(len(shares)):
        own = [at[i, c + 1] for i in ids]
        got = np.array([r.whitened for r in own])
        assert min(np.abs(got - white[:, c]).max(), np.abs(got + white[:, c]).max()) < 1e-7
        assert [int(r.deviation) for r in own] == far and {r.n for r in own} == {n}
        assert all(abs(r.explained / shares[c] - 1) < 1e-9 for r in own) and max(r.identity_error for r in own) < 1e-7


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigen_solver(n):
    r = np.random.default_rng(n)
    for a in (r.standard_normal((n, n)), np.diag(r.standard_normal(n)), np.ones((n, n)), np.zeros((n, n)), r.standard_normal((n, 1)) * np.ones(n), np.eye(n)):
        a = a + a.T
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).sum()))
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-13 * n) and np.allclose(axes.T @ np.diag(values) @ axes, a, atol=1e-12 * max(1, np.abs(a).sum()))


def test_moments_merge():
    x = np.random.default_rng(2).standard_normal((300, 5)) * [1, 10, 1e-3, 1e4, 1] + 1e6
    parts = []
    for some in np.split(x, [0, 1, 100, 250]):
        parts.append(whitening.Moments(5))
        for row in some:
            parts[-1].add(row)
    whole = whitening.Moments(5)
    for p in parts:
        whole.merge(p)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(0)) and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-7)


def test_query_against_plain(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(op11_whitening(spark, SF).collect(), [i for i, _ in table], [v for _, v in table])


def test_odd_vectors(spark):
    """Nulls, empty vectors, other lengths, great entries, repeated and null ids, clashing names."""
    r = np.random.default_rng(5)
    good = [[float(c) for c in r.standard_normal(3) * [1, 5, 1e3]] for _ in range(30)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1e300, 0.0, 1.0], [1.0, 2.0]]
    rows = [(f"k{i}", v, "x", 0.0) for i, v in enumerate(good)] + [(f"b{i}", v, "x", 0.0) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "key string, vec array<double>, component string, whitened double").repartition(5)
    model = whitening.fit(frame, "vec")
    held(whitening.whiten(frame, model, "key", "vec").collect(), [f"k{i}" for i in range(30)], good, "key")
    assert whitening.fit(frame.where("key like 'b%' and key <> 'b6'"), "vec") is None
    assert whitening.whiten(frame, None, "key", "vec").collect() == [] == whitening.whiten(frame.limit(0), model, "key", "vec").collect()
    great = [[1.0 * 2**41 * (i % 3), -(2.0**40) * i, 3.0] for i in range(9)]
    table = spark.createDataFrame(list(enumerate(great)), "vec_id long, embedding array<double>")
    n, far, white, shares = plain(great)
    out = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(shares) == 2 and len(out) == 18 and {(x.vec_id, int(x.deviation)) for x in out} == set(enumerate(far))


def test_equal_and_repeated_rows(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25])] * 4, "vec_id int, embedding array<float>")
    model = whitening.fit(same)
    assert model.n == 4 and len(model.values) == 0 and whitening.whiten(same, model).collect() == []
    two = spark.createDataFrame([(1, [0.5, 0.25])] * 2 + [(None, [0.0, 1.0])] * 2, "vec_id int, embedding array<float>")
    out = whitening.whiten(two, whitening.fit(two)).collect()
    assert sorted((x.vec_id or 0, x.component) for x in out) == [(0, 1), (0, 1), (1, 1), (1, 1)] and all(abs(abs(x.whitened) - 1) < 1e-12 for x in out)
