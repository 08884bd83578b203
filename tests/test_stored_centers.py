"""Consolidation queries on all stored centers: none is left out, and what has no SQL agrees with NumPy."""

import numpy as np
import pytest
from compare import connect

from cairn.plans.cluster_queries import CONSOLIDATION, QUERIES, SQL, _FEW

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored():
    rows = connect(AT).execute("SELECT unnest(l) FROM (SELECT partition_id, max(centers_list) AS l FROM localcentersperpartition GROUP BY 1 ORDER BY 1)").fetchall()
    return np.array([r[0] for r in rows if r[0] is not None], float)


def test_every_query_has_a_whole_form():
    assert all(f"stored_{n}" in QUERIES and _FEW not in SQL[f"stored_{n}"] and "vec_id" not in SQL[f"stored_{n}"] for n in CONSOLIDATION)


def test_all_centers_are_taken(spark, stored):
    n = len(stored)
    assert n > 24
    assert QUERIES["stored_center_distances"](spark, AT).count() == n * (n - 1) // 2
    assert QUERIES["stored_density_labels"](spark, AT).count() == QUERIES["spectral_labels"](spark, AT).count() == n


def test_cut_off_by_numpy(spark, stored):
    n = len(stored)
    d = 1 - np.exp(-((stored[:, None] - stored[None]) ** 2).sum(2) / 2)[np.triu_indices(n, 1)]
    dc = QUERIES["density_cut_off"](spark, AT).first()["dc"]
    assert 0.01 <= (d < dc).sum() * 2 / n**2 <= 0.02
