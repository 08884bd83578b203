"""The rank for a share of the variance is that of all singular values."""

import numpy as np
from compare import connect

from cairn.plans.matrix_queries import QUERIES

AT = "/root/testdata/sf0.001"


def test_rank_of_the_whole_spectrum(spark):
    x = np.array([r[0] for r in connect(AT).execute("SELECT embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall()], float)
    share = np.cumsum(np.linalg.svd(x, compute_uv=False) ** 2) / (x**2).sum()
    r = QUERIES["rank_and_elbows"](spark, AT).first()
    k = int((share < 0.95 - 1e-12).sum()) + 1
    assert r["k"] == k and abs(r["reached"] - share[k - 1]) < 1e-5
