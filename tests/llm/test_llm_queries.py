"""The queries tagged llm: against SQL where there is some, else that they run and keep their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import assert_same, connect  # noqa: E402

from cairn.llm.queries import QUERIES, SQL  # noqa: E402

AT = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["term_index", "mark"], "p2_found": ["submission_id", "cluster_label"], "p3_found": ["partition_id", "cluster_label", "term_rank", "term_code"],
    "p4_found": ["vec_a", "vec_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, AT), connect(AT), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, AT)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
