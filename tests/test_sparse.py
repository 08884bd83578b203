"""Sparse decomposition against NumPy."""

import numpy as np
import pytest

from cairn.operators.reduce import sparse_project, sparse_singular_values


@pytest.mark.parametrize("n,size,k", [(120, 60, 5), (30, 12, 12), (5, 40, 8)])
def test_sparse_svd(spark, n, size, k):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, size)) * (rng.uniform(size=(n, size)) < 0.2)
    rows = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(a)], "id bigint, idx array<int>, vals array<double>").repartition(3)
    values, right = sparse_singular_values(rows, size, k)
    want = np.zeros(k)
    s = np.linalg.svd(a, compute_uv=False)[:k]
    want[: len(s)] = s
    assert np.allclose(values, want, atol=1e-6 * want[0])
    u = np.array([r["u"] for r in sparse_project(rows, values, right).orderBy("id").collect()])
    live = want > 1e-6
    assert np.allclose((u.T @ u)[np.ix_(live, live)], np.eye(live.sum()), atol=1e-5)
