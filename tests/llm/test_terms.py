"""Term counts and top terms against brute force, with dirt."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm.term_counts import mark_terms, term_counts
from cairn.llm.top_items import top_items


def brute(rows):
    occ, rec = collections.Counter(), collections.defaultdict(set)
    for r, terms, weights in rows:
        for t, w in zip(terms or [], weights or []):
            if t is not None and w:
                occ[t] += w
                rec[t].add(r)
    return {t: (occ[t], len(rec[t])) for t in rec}


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_counts_match_sets(spark, most):
    rnd = random.Random(1)
    rows = [(f"r{i // 3}", [rnd.choice(["a", "b", None, f"t{rnd.randrange(40)}"]) for _ in range(rnd.randrange(6))]) for i in range(300)]
    rows = [(r, t, [rnd.choice([1.0, 2.0, 0.0, None]) for _ in t]) for r, t in rows] + [("null", None, None), ("empty", [], [])]
    df = spark.createDataFrame(rows, "record string, terms array<string>, weights array<double>").repartition(4, "record").sortWithinPartitions("record")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, "record", F.col("terms"), F.col("weights"), "string", most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.pop(None)[1] == 102
    assert got == brute(rows)


def test_marks(spark):
    df = spark.createDataFrame([(i, [1, 2] if i % 2 else [1], [1.0, 1.0] if i % 2 else [1.0]) for i in range(1001)], "record int, terms array<int>, weights array<double>")
    known = spark.createDataFrame([(1,), (7,), (None,)], "term int")
    got = {r["term"]: (r["records"], r["mark"]) for r in mark_terms(term_counts(df, "record", F.col("terms"), F.col("weights"), "int"), known).collect()}
    assert got == {1: (1001, "common"), 2: (500, None), 7: (0, "rare")}
    none = mark_terms(term_counts(df.limit(0), "record", F.col("terms"), F.col("weights"), "int"), known).collect()
    assert {(r["term"], r["mark"]) for r in none} == {(1, None), (7, None)}


def test_top_items_ties_nulls(spark):
    rows = [("g", 1.0, 3), ("g", 1.0, 1), ("g", 2.0, 9), (None, 5.0, 1), ("h", None, 1)]
    got = top_items(spark.createDataFrame(rows, "g string, w double, i int"), ["g"], [F.col("w").desc(), F.col("i")], 2).collect()
    assert {(r["g"], r["item_rank"], r["i"]) for r in got} == {("g", 1, 9), ("g", 2, 1), (None, 1, 1), ("h", 1, 1)}
    with pytest.raises(ValueError):
        top_items(spark.range(1), [], [], 0)
    clash = spark.createDataFrame([("g", 7, 1)], "g string, item_rank int, i int")
    assert top_items(clash, ["g"], [F.col("i")], 2).first().asDict() == {"g": "g", "item_rank_kept": 7, "i": 1, "item_rank": 1}
    assert top_items(clash.limit(0), ["g"], [F.col("i")], 2).count() == 0


def test_group_limit_before_and_after_the_shuffle(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = top_items(items, ["l_suppkey"], [F.col("l_quantity").desc(), F.col("l_orderkey")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_group_limits_of_the_query(spark):
    """p3_found itself prunes a delivery's items before anything is shuffled, and again after."""
    from cairn.llm.term_queries import p3_found

    plan = p3_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count(", Partial") >= 1 and plan.index("Final") < plan.index("Partial")
