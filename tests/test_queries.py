"""Every query of the core against its SQL on the smallest data set; those without SQL run and keep their columns."""

import pytest
from compare import assert_same, connect

from cairn.plans.catalogue import QUERIES, SQL

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(AT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sql, name):
    assert_same(QUERIES[name](spark, AT), sql, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, AT)
    rows = df.count()
    assert len(set(df.columns)) == len(df.columns) and (rows > 0 or name in {"two_layer_check"})


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["cluster", "size", "top_code"]
