"""Recall of the pair index at the least cosine, for tables larger than a test can hold."""

import numpy as np
import pytest

from cairn.llm.neighbours import StableHashes, hashes_for, tables_for


def recall(tables, hashes, cos=0.95, pairs=1500):
    rng = np.random.default_rng(3)
    h = StableHashes(100, tables, hashes, 1.5, 4)
    hit = 0
    for _ in range(pairs // 250):
        a, e = rng.standard_normal((2, 250, 100))
        a /= np.linalg.norm(a, axis=1)[:, None]
        e -= (e * a).sum(1)[:, None] * a
        e /= np.linalg.norm(e, axis=1)[:, None]
        (ka, va), (kb, vb) = h.keys(a), h.keys(cos * a + np.sqrt(1 - cos * cos) * e)
        hit += ((ka == kb) | (va == kb[:, :, None]).any(2) | (vb == ka[:, :, None]).any(2)).any(1).sum()
    return hit / pairs


@pytest.mark.parametrize("n", [3_000, 123_000, 1_230_000])
def test_recall_does_not_fall_with_the_size(n):
    hashes = hashes_for(n)
    assert recall(tables_for(100, hashes, 1.5, 4, 0.95), hashes) >= 0.99
