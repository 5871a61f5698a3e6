"""Whitening against numpy's eigenvectors and singular values, exact sums in Python, and edges."""

import math

import numpy as np
import pytest

from loglane.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, whitened string, n string"


def run(spark, rows, partitions=3, **options):
    df = spark.createDataFrame([(i, v, "a", None) for i, v in rows], SCHEMA).repartition(partitions)
    return {(r.row.vec_id, i): r for i, r in enumerate(sorted(wh.whiten(df, **options).collect(), key=lambda r: (r.row.vec_id, r.deviation)))}


def check(got, rows, most=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(rows, x, strict=True))
    assert [(r.row.vec_id, r.deviation) for r in got.values()] == deviation
    apart = np.array([[a * n - s for a, s in zip(v, sums, strict=True)] for v in x], float) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-14).sum()))
    by_id = {}
    for (i, _), row in zip(rows, apart, strict=True):
        by_id.setdefault(i, []).append(row @ vectors[:, :k] / np.sqrt(values[:k]))
    signs = None
    for r in got.values():
        assert r.n == n and len(r.whitened) == k and r.identity_error < 1e-9
        assert np.allclose(r.explained, values[:k] / values.sum(), rtol=1e-9)
        w = np.array(r.whitened)
        match = min(by_id[r.row.vec_id], key=lambda v: np.abs(np.abs(v) - np.abs(w)).sum())
        if signs is None or (signs == 0).any():
            signs = np.where(np.abs(match) > 1e-3, np.sign(match * w), 0)
        ok = (signs == 0) | np.isclose(w, signs * match, rtol=1e-6, atol=1e-6)
        assert ok.all(), (r.row.vec_id, w, match)


@pytest.mark.parametrize("n, width, block", [(300, 12, 1 << 20), (300, 12, 50), (40, 3, 7), (9, 20, 64)])
def test_like_eigenvectors(spark, monkeypatch, n, width, block):
    """Many rows, few rows, fewer rows than entries; small blocks change nothing."""
    monkeypatch.setattr(wh, "BLOCK", block)
    monkeypatch.setattr(wh, "FAN_IN", 2)
    r = np.random.default_rng(n + width)
    x = r.normal(size=(n, width)) * np.geomspace(3, 0.05, width) + r.normal(size=width)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5, x[5].tolist())]
    check(run(spark, rows, 5), rows)


def test_odd_vectors(spark):
    good = [(i, [float(i % 7), float(i * i % 5), 2.0]) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [math.nan, 1.0, 2.0]), (94, [math.inf, 1.0, 2.0]), (95, [1.0]), (96, [1e300, 0.0, 0.0])]
    check(run(spark, good + bad), good)
    assert run(spark, []) == {}
    assert run(spark, bad[:5]) == {}
    same = run(spark, [(1, [1.5, 2.0])] * 4)
    assert len(same) == 4 and all(r.whitened == [] and r.explained == [] and r.deviation == 0 and r.n == 4 for r in same.values())
    with pytest.raises(ValueError):
        run(spark, good, most=0)


def test_large_numbers_stay_exact(spark):
    far = [(i, [4e12 * (-1) ** i, 1e9 * i]) for i in range(4)]
    assert [r.deviation for r in run(spark, far).values()] == [None] * 4
    rows = [(i, [4e5 * (-1) ** i, 3.0 * i]) for i in range(6)]
    check(run(spark, rows), rows)


@pytest.mark.parametrize("case", range(12))
def test_solver(case):
    """Values to high relative accuracy, orthonormal vectors; equal, tiny and missing values, matrices that fall apart."""
    r = np.random.default_rng(case)
    d = [1, 2, 5, 30, 64, 64][case % 6]
    a = r.normal(size=(d, d))
    if case in (3, 9):
        q, _ = np.linalg.qr(a)
        a = q * 3.0
    if case in (4, 10):
        q, _ = np.linalg.qr(a)
        p, _ = np.linalg.qr(r.normal(size=(d, d)))
        a = q @ np.diag(np.repeat([5.0, 5.0 * (1 + 1e-9), 2.0, 1e-3], d // 4)) @ p
    if case == 5:
        a[:, 3] = a[:, 7] = 0
    if case == 11:
        a = np.diag([2.0] * 20 + [1.0] * 44)
    diagonal, upper, right = wh.bidiagonal(a)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(right @ b.T @ b @ right.T, a.T @ a, atol=1e-11)
    values = wh.squared_singular_values(diagonal, upper)
    want = np.linalg.svd(b, compute_uv=False) ** 2
    assert len(values) == d and np.allclose(values, want, rtol=1e-12, atol=1e-13 * want[0])
    k = min(d, 8)
    z = wh.singular_vectors(diagonal, upper, values[:k])
    assert np.allclose(z.T @ z, np.eye(k), atol=1e-13)
    assert np.allclose(b.T @ (b @ z), z * values[:k], atol=1e-12 * max(1, want[0]) * d)


def test_small_values_are_found_to_relative_accuracy():
    diagonal, upper = np.array([1.0, 1e-8, 1e-16]), np.array([1.0, 1e-8])
    values = wh.squared_singular_values(diagonal, upper)
    # The product of the singular values is that of the diagonal.
    assert math.isclose(math.sqrt(values.prod()), diagonal.prod(), rel_tol=1e-12)
