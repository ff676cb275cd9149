"""Whitening against a full eigendecomposition."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from evoframe.llm import queries, whitening


def check(found, vectors: list[tuple], k: int = 8) -> None:
    whole = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in vectors], object)
    n, sums = len(whole), whole.sum(axis=0)
    apart = whole * n - sums
    x = apart.astype(float) / n
    cov = x.T @ x / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:k] > 1e-9 * values[0]).sum())
    assert len(found) == k * n
    rows = defaultdict(list)
    for r in found:
        rows[r.component].append(r)
    assert sorted(rows) == list(range(1, k + 1))
    deviation = sorted((vec_id is not None, vec_id or 0, int(sum(v * v for v in row))) for (vec_id, _), row in zip(vectors, apart))
    for c, some in rows.items():
        assert {r.n for r in some} == {n} and max(r.identity_error for r in some) < 1e-9
        assert sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in some) == deviation
        assert abs(some[0].explained - values[c - 1] / cov.trace()) < 1e-10
        want = sorted(zip([v for v, _ in vectors], (x @ axes[:, c - 1] / np.sqrt(values[c - 1])).tolist()), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        got = sorted(((r.vec_id, r.whitened) for r in some), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        a, b = np.array([w for _, w in want]), np.array([w for _, w in got])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7 * np.abs(a).max()


def test_real_vectors(spark, small):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, small).collect(), [v for v in vectors if v[1] is not None and all(c is not None and np.isfinite(c) for c in v[1])])


@pytest.mark.parametrize("dim, block", [(3, 32), (150, 10), (60, 9)])
def test_more_dimensions_than_the_block(spark, dim, block):
    draw = np.random.default_rng(dim)
    data = draw.standard_normal((300, dim)) * np.linspace(3, 1, dim) + draw.standard_normal(dim)
    vectors = [(i, row.tolist()) for i, row in enumerate(data)]
    found = whitening.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5), block=block).collect()
    check(found, vectors)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.5, -2.0, 1.0]), (4, [7.0, 1.0, -1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [1.0, inf, 2.0]), (10, [1.0]), (None, None)]
    schema = "vec_id long, embedding array<double>, n int, x string, whitened string"
    docs = spark.createDataFrame([(*r, 1, "a", "b") for r in good + bad], schema)
    check(whitening.whitened(docs).collect(), good)
    for none in ([], bad[:2], good[:2], good[:1]):
        assert whitening.whitened(spark.createDataFrame([(*r, 1, "a", "b") for r in none], schema)).count() == 0


def test_large_entries(spark):
    vectors = [(i, [float(i) * 1e9, 1.0 - i, 2e9 * (i % 3)]) for i in range(9)]
    found = whitening.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    whole = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in vectors], object)
    apart = whole * 9 - whole.sum(axis=0)
    for r in found:
        want = sum(v * v for v in apart[r.vec_id])
        assert r.deviation == (want if want < 1 << 63 else None)
    beyond = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(beyond).where("identity_error < 0.0001").count() >= 3
