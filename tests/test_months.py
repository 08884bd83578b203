"""The reconstruction takes every month of the table."""

from compare import connect

from cairn.plans.matrix_queries import QUERIES

AT = "/root/testdata/sf0.001"


def test_all_months(spark):
    want = {r[0] for r in connect(AT).execute("SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_shipdate IS NOT NULL").fetchall()}
    assert len(want) > 3 and {r["month"] for r in QUERIES["monthly_reconstruction_all"](spark, AT).collect()} == want
