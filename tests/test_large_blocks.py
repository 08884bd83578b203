"""Local fits of large blocks: the same results as by all pairs, in a time that grows with the points."""

import time

import numpy as np

from cairn.operators import density as D
from cairn.operators import fit, mixture as M
from cairn.functions.special import log_gamma_pdf


def brute(ids, x, k):
    return int(np.lexsort((ids, np.round(D.knn_distances(x, k).mean(1), 12)))[0])


def test_kernel_sums_equal_all_pairs():
    rng = np.random.default_rng(0)
    n = 6000
    cases = [rng.gamma(3, 1, n), np.concatenate([rng.normal(m, 0.3, n // 3) for m in (3, 5, 9)]), np.concatenate([rng.gamma(2, 1, n - 50), rng.uniform(50, 500, 50)]), np.repeat(rng.gamma(3, 1, n // 4), 4)]
    for s in cases:
        t = np.sort(s) / 0.15
        a, b = fit.gauss_sums(t, 10**9), fit.gauss_sums(t)
        assert np.abs(a / b - 1).max() < 1e-13
        assert (((a[1:-1] > a[:-2]) & (a[1:-1] > a[2:])) == ((b[1:-1] > b[:-2]) & (b[1:-1] > b[2:]))).all()


def test_densest_of_many_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n, dim, k in ((6000, 5, 3), (5000, 2, 7), (5000, 1, 3), (5000, 10, 3)):
        x, ids = rng.standard_normal((n, dim)) * rng.gamma(1, 1, (n, 1)), rng.permutation(n)
        assert D.densest(ids, x, k) == brute(ids, x, k)
        for copies in (2, 4):  # too few copies, and enough of them
            y, ids2 = np.repeat(x, copies, 0)[: 2 * n], rng.permutation(2 * n)
            assert D.densest(ids2, y, k) == brute(ids2, y, k)


def test_expected_equals_one_stroke():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.gamma(20, 0.1, 5000), rng.gamma(50, 0.1, 5000)])
    g = M.moments_start(x, 4)
    z = np.log(g.weight) + log_gamma_pdf(x, g.shape, g.scale)
    r = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    loglik, sums = M.expected(x, np.log(x), g)
    assert abs(loglik - np.log(np.exp(z).sum(1)).sum()) < 1e-6
    for a, b in zip(sums, (r.sum(0), r.T @ x, r.T @ np.log(x))):
        assert np.allclose(a, b, rtol=1e-9)


def test_a_block_of_a_quarter_million():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((50_000, 5)) * 0.1 + c for c in 3 * rng.standard_normal((5, 5))])
    x[:5000] = x[0]  # copies, too
    began = time.time()
    g, centers = fit.fit_profile(np.arange(len(x)), x, np.sqrt((x * x).sum(1)), 3, "window", 1)
    assert len(centers) >= 3 and time.time() - began < 120
