import math
import random

import numpy as np
import pytest

from labelmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, whitened string, deviation string, i string"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "w", "d", "i") for k, v in rows], SCHEMA).repartition(3)


def plain(rows, k):
    """By whole numbers and a dense solver."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found = {}
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        found[i] = sum(v * v for v in d), np.array([v / n for v in d]) @ vectors / np.sqrt(values)
    return n, values / np.trace(cov), found


@pytest.mark.parametrize(("n", "d", "k"), [(300, 24, 16), (60, 5, 5), (40, 1, 1)])
def test_as_a_dense_solver(spark, n, d, k):
    draw = np.random.default_rng(d)
    mixed = draw.standard_normal((d, d)) * 2.0 ** -np.arange(d)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.standard_normal((n, d)) @ mixed * 3)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once
    rows += [(2000, None), (2001, [float("nan")] * d), (2002, [float("inf")] * d), (2003, [None] * d)]
    df = table(spark, rows)
    model = whitening.fit(df)
    count, explained, want = plain(rows, k)
    assert model.n == count
    assert np.allclose(model.explained, explained, rtol=1e-9)
    assert model.identity_error < 1e-9
    got = whitening.whiten(df, model).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(want)
    white = np.array([r["whitened"] for r in got])
    theirs = np.array([want[r["vec_id"]][1] for r in got])
    signs = np.sign((white * theirs).sum(axis=0))
    assert np.allclose(white * signs, theirs, rtol=1e-6, atol=1e-7)
    assert all(r["deviation"] == want[r["vec_id"]][0] for r in got)
    assert got[0]["x"] == 1 and got[0]["i"] == "i"


def test_close_and_repeated_eigenvalues():
    draw = np.random.default_rng(3)
    for spectrum in ([3.0] * 20 + [1.0] * 20, [5 + 1e-9 * i for i in range(12)] + [3 + 1e-3 * i for i in range(30)], [10.0**-i for i in range(30)], [7.0, 0, 0, 0]):
        q = np.linalg.qr(draw.standard_normal((len(spectrum),) * 2))[0]
        matrix = q @ np.diag(spectrum) @ q.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.leading(matrix, 16)
        held = sum(v > 1e-13 for v in spectrum)
        assert min(16, held) - 2 <= len(values) <= 16
        assert np.allclose(values, sorted(spectrum, reverse=True)[: len(values)], atol=1e-12)
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_inertia():
    draw = np.random.default_rng(4)
    for n in (1, 2, 3, 17):
        a = draw.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        shifts = np.concatenate([values - 1e-6, values + 1e-6, [-100, 100]])
        assert whitening.above(whitening.tridiagonal(a), shifts).tolist() == [(values > s).sum() for s in shifts]


def test_edges(spark):
    empty = table(spark, [])
    model = whitening.fit(empty)
    assert model.n == 0 and whitening.whiten(empty, model).collect() == []
    nothing = table(spark, [(1, None), (2, []), (3, [None])])
    assert whitening.whiten(nothing, whitening.fit(nothing)).collect() == []
    one = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [1.0])])
    model = whitening.fit(one)
    got = whitening.whiten(one, model).collect()
    assert model.n == 1 and [(r["whitened"], r["deviation"]) for r in got] == [([], 0)] * 3
    own = whitening.whiten(one.select("embedding"), model, out="embedding")
    assert own.columns == ["embedding", "deviation"] and own.count() == 3


def test_large_numbers(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1e16, 1e16, 3e15]), draw.random()]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert all(r["deviation"] is None for r in whitening.whiten(df, model).collect())
    assert model.identity_error < 1e-4
