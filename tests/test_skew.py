"""Heavy keys take another route to the same result."""

import collections

import pytest
from pyspark.sql import functions as F

from cairn.operators.skew import heavy_hitters, key_hash, member_counts, skew_join

FACTS, DIMS = "p int, k int, x int", "p int, k int, size bigint, x string"


@pytest.fixture()
def tables(spark):
    facts = [(1, 7, i) for i in range(500)] + [(None, 7, i) for i in range(100)] + [(i % 5, i, i) for i in range(60)]
    dims = [(1, 7, 500, "a"), (None, 7, 99, "b"), (0, 0, None, "c"), (9, 9, 3, "d"), (2, 2, 1, None)]
    return spark.createDataFrame(facts, FACTS).repartition(4), spark.createDataFrame(dims, DIMS), facts, dims


def test_heavy_hitters(spark, tables):
    facts = tables[0]
    found = heavy_hitters(facts, ["p", "k"], 0.1)
    named = {(r["p"], r["k"]) for r in facts.filter(key_hash(["p", "k"]).isin(found)).select("p", "k").distinct().collect()}
    assert named == {(1, 7), (None, 7)}
    assert heavy_hitters(facts.limit(0), ["p"]) == []
    with pytest.raises(ValueError):
        heavy_hitters(facts, ["p"], 1.5)


@pytest.mark.parametrize("share", [0.001, 0.1, 0.9])
def test_member_counts(tables, share):
    facts, dims, rows, stated = tables
    got = {(r["p"], r["k"]): (r["members"], r["size"]) for r in member_counts(facts, dims, ["p", "k"], "size", share=share).collect()}
    count = collections.Counter((p, k) for p, k, _ in rows)
    sizes = {(p, k): s for p, k, s, _ in stated}
    assert got == {key: (count.get(key, 0), sizes.get(key)) for key in count.keys() | sizes.keys()}


def test_empty_sides(tables):
    facts, dims, _, _ = tables
    assert member_counts(facts.limit(0), dims, ["p", "k"], "size").filter("members = 0").count() == 5
    assert member_counts(facts, dims.limit(0), ["p", "k"], "size").filter("size is null").count() == 62
    assert member_counts(facts.limit(0), dims.limit(0), ["p", "k"], "size").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_is_a_join(tables, how):
    facts, dims, _, _ = tables
    heavy = heavy_hitters(facts, ["p", "k"], 0.1)
    assert heavy
    got = skew_join(facts, dims, ["p", "k"], heavy, how)
    assert got.columns == ["p", "k", "x", "size", "x_dim"]
    d = dims.toDF("p2", "k2", "size", "x_dim")
    want = facts.join(d, F.col("p").eqNullSafe(F.col("p2")) & F.col("k").eqNullSafe(F.col("k2")), how).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        skew_join(facts, dims, ["p"], heavy, "full")


def test_heavy_rows_are_not_shuffled(tables):
    facts, dims, _, _ = tables
    plan = skew_join(facts, dims, ["p", "k"], heavy_hitters(facts, ["p", "k"], 0.1))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
