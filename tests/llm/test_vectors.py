"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from brute import Groups

from loglane.llm import neardup

SCHEMA = "vec_id long, embedding array<double>, node string, copies string"


def brute(rows, least=0.95):
    groups, ids = Groups(len(rows)), [r[0] for r in rows]
    vectors = [np.array(v, float) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) else None for _, v in rows]
    # Scaled first, so that no square overflows or vanishes.
    vectors = [v if v is None else v / np.abs(v).max() for v in vectors]
    links = [0] * len(rows)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    return [(x, n, c if v is not None else x, (c if v is not None else x) == x) for x, v, n, c in zip(ids, vectors, links, groups.least(ids), strict=True)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "n", None) for i, v in rows], SCHEMA)
    return sorted(map(tuple, neardup.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("part", [8, 4096])
def test_clusters(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    r = np.random.default_rng(part)
    rows = [(i, r.normal(size=20).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 4][1]) + r.normal(0, 0.1, 20)).tolist()) for i in range(90)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, (3 * np.array(rows[7][1])).tolist())]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (7, [1.0]), (8, [-1.0])]
    rows += [(9, [1e300, 1e300]), (10, [1e-300, 1e-300]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 1.0])]
    assert run(spark, rows) == sorted(brute(rows), key=repr)
    assert run(spark, []) == []
    assert run(spark, [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0])]) == sorted(
        [(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=repr
    )


def test_wide_vectors(spark):
    r = np.random.default_rng(9)
    x, y = r.normal(size=(2, 32768))
    rows = [(1, x.tolist()), (2, (x + 0.01 * y).tolist()), (3, y.tolist()), (4, y[:20000].tolist()), (5, (2 * y[:20000] + 0.001).tolist())]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_recall_at_the_threshold():
    """Pairs of cosine 0.95 meet with the tables of the query."""
    r = np.random.default_rng(5)
    x, z = (v / np.linalg.norm(v, axis=1)[:, None] for v in (r.normal(size=(2000, 64)), r.normal(size=(2000, 64))))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = neardup.codes(x), neardup.codes(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    met = ((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() > 0.99
    h = neardup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)
