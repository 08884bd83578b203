"""Spectral grouping of many centers: one square array in memory, and the labels of the whole decomposition."""

import tracemalloc

import numpy as np
import pytest

from cairn.operators import consolidate as C


def planted(n, groups, dim=100, apart=4.0, seed=5):
    rng = np.random.default_rng(seed)
    means = apart * np.linalg.qr(rng.standard_normal((dim, groups)))[0].T
    truth = np.sort(rng.integers(0, groups, n))
    return means[truth] + 0.02 * rng.standard_normal((n, dim)), truth


def test_memory_is_one_square_array():
    n = 3000
    x, truth = planted(n, 6)
    tracemalloc.start()
    try:
        label = C.spectral_groups(x, 1.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * 8 * n * n  # the differences of all pairs alone are 100 square arrays
    assert len(set(zip(label, truth))) == len(set(label)) == len(set(truth)) == 6


@pytest.mark.parametrize("groups", [1, 5, 40])
def test_blocks_find_what_the_whole_decomposition_finds(groups):
    """Also with more equal eigenvalues than a block is wide."""
    x, _ = planted(600, groups)
    s = C.similarities(x)
    values, vectors = np.linalg.eigh(np.diag(s.sum(1)) - s)
    assert np.allclose(s, np.exp(-C.squared(x, x)))
    for small in (1e-4, 5.0, float(values[-1]) * 0.98):
        k = max(1, int((values < small).sum()))
        got = C.smallest_eigenvectors(s, small)
        assert got.shape == (600, k) and np.abs(got @ got.T - vectors[:, :k] @ vectors[:, :k].T).max() < 1e-6


def test_copies_of_lone_centers():
    """Equal eigenvalues in sets of three, and equal distances: both ways give the same numbers."""
    rng = np.random.default_rng(1)
    x = np.tile(np.concatenate([0.02 * rng.standard_normal((300, 20)), 5 * np.eye(20)[:6]]), (4, 1))
    whole = C.DENSE
    try:
        labels = []
        for C.DENSE in (10**6, 10):
            labels.append(C.spectral_groups(x, 5.0))
    finally:
        C.DENSE = whole
    assert (labels[0] == labels[1]).all() and len(set(labels[0])) == 1 + 6 * 4
