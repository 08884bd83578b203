"""Evaluation, document-term, reduction and file operators: golden values and dirt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluate as E
from cairn.operators import reduce as R
from cairn.operators import terms as T
from cairn.sources import files as S

TRUTH, FOUND = [0, 0, 1, 1, 2, 2, 0, 1, 2, 2], [2, 2, 2, 2, 2, 2, 1, 0, 2, 2]


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "truth int, cluster int")


def test_agreement(spark):
    p = pairs(spark, TRUTH, FOUND)
    assert E.purity(p).first()[0] == 0.6 and abs(E.adjusted_rand(p).first()[0] - 0.042553191489361694) < 1e-12
    same = pairs(spark, TRUTH, [(x + 1) % 3 for x in TRUTH])
    assert E.adjusted_rand(same).first()[0] == 1.0 == E.purity(same).first()[0]
    assert E.adjusted_rand(pairs(spark, [1, 1], [2, 2])).first()[0] == 1.0 and E.adjusted_rand(pairs(spark, [1], [2])).first()[0] == 1.0
    assert E.purity(p.limit(0)).first()[0] is None and E.adjusted_rand(p.limit(0)).first()[0] is None
    assert E.purity(p.unionByName(pairs(spark, [None], [1]))).first()[0] == 0.6


def test_cluster_reports(spark):
    d = spark.createDataFrame([(1,)] * 6 + [(2,)] + [(None,)], "cluster_label int")
    assert {(r[0], r[1]) for r in E.cluster_distribution(d).collect()} == {(1, 6), (2, 1), (None, 1)}
    x = E.cluster_extremes(d, 3).first()
    assert (x["largest"], x["smallest"], x["ratio"], x["imbalanced"], round(x["mean_size"], 3)) == (1, 2, 6.0, True, 2.333)
    w = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 9, 0.1), (1, 4, 0.0), (1, 5, -0.1)], "g int, term_index int, weight double")
    codes = spark.createDataFrame([(2, "T2"), (2, "T2"), (9, None)], "term_index int, term_code string")
    assert [(r["term_rank"], r["term_code"]) for r in E.ranked_terms(w, ["g"], 5, codes).orderBy("term_rank").collect()] == [(1, "T2"), (2, "unknown_3"), (3, "unknown_9")]
    assert E.ranked_terms(w, ["g"], 9, codes, positive=False).count() == 5
    runs = E.run_statistics(spark.createDataFrame([(1.0,), (3.0,)], "x double"), "x").first()
    assert tuple(runs) == (2.0, 1.0)


def entries(spark):
    rows = [("a", 1, 1.0), ("a", 3, 2.0), ("b", 1, 1.0), ("b", 3, 3.0), ("b", 0, 0.0)]
    return spark.createDataFrame(rows, "doc_id string, term_index int, value double")


def test_terms(spark):
    e = entries(spark)
    assert {tuple(r) for r in T.document_frequency(e).collect()} == {(1, 2), (3, 2)}
    assert [r["doc_freq"] for r in T.document_frequency_filled(e, 5).orderBy("term_index").collect()] == [0, 2, 0, 2, 0]
    m = {r["term_index"]: tuple(r)[1:] for r in T.term_moments(spark.createDataFrame([("a", 0, 3.0), ("b", 0, 5.0)], e.schema)).collect()}
    assert m == {0: (8.0, 34.0, 2)}
    s = {r["term_index"]: r for r in T.term_statistics(spark.createDataFrame([("a", 0, 3.0), ("b", 0, 5.0)], e.schema), 2).collect()}
    assert s[0]["variance"] == 2.0 and s[1]["count"] == 0 and s[1]["mean"] == 0.0
    kept, valid = T.term_filter(e, 2, 0.1, max_df=9)
    assert [tuple(r)[:3] for r in valid.collect()] == [(3, 0, 2)] and {tuple(r) for r in kept.collect()} == {("a", 0, 2.0), ("b", 0, 3.0)}
    kept, valid = T.term_filter(e, 9, 0.1, max_ratio=1.0)
    assert valid.count() == 0 and kept.columns == ["doc_id", "term_index", "value"] and kept.count() == 0
    for bad in (lambda: T.term_filter(e, 1, 0.1), lambda: T.valid_terms(e, 5, 2, 0.0), lambda: T.valid_terms_by_ratio(e, 1, 2.0, 0.0, 2), lambda: T.frequency_percentiles(T.document_frequency(e), 0.9, 0.1)):
        with pytest.raises(ValueError):
            bad()
    none = e.limit(0)
    assert tuple(T.frequency_percentiles(T.document_frequency(none)).first()) == (1, 1) and T.term_statistics(none).count() == 0
    assert T.with_all_documents(kept, e.select("doc_id").distinct()).filter("n_terms = 0").count() == 2
    assert abs(T.l2_normalised(e).filter("doc_id = 'b'").agg(F.sum(F.col("value") ** 2)).first()[0] - 1) < 1e-12
    assert T.month_list("2011-11", "2012-01", spark).count() == 3 and T.month_list("2012-01", "2011-11", spark).count() == 0


def test_wide_tables(spark):
    words = spark.createDataFrame([(0, "w0"), (1, "w1"), (2, "w2"), (2, "w2")], "term_index int, original_word string").dropDuplicates()
    a = spark.createDataFrame([("a", 1, None, "x"), ("b", 0, 2.5, "7")], "id string, w0 int, w1 double, w2 string")
    b = spark.createDataFrame([("a", 4, True), ("c", 1, False)], "id string, w0 bigint, other boolean")
    assert {tuple(r) for r in T.wide_to_entries([(a, "id")], words).collect()} == {("a", 0, 1.0), ("b", 1, 2.5), ("b", 2, 7.0)}
    assert {tuple(r) for r in T.wide_to_entries([(a, "id"), (b, "id")], words).collect()} == {("a", 0, 5.0)}
    d = T.code_dictionary(spark.createDataFrame([("b", "T10"), ("a", "T9"), ("a", "T9"), (None, "T1"), ("c", None)], "original_word string, term_code string"))
    assert [tuple(r) for r in d.orderBy("term_index").collect()] == [(0, "a", "T9"), (1, "b", "T10")]
    assert T.alphabetical_dictionary(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "original_word string")).count() == 2


def test_reduction(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)) @ np.diag([5, 3, 1, 0.1])
    p = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    s, v = R.singular_values(p, 4)
    assert np.allclose(s, np.linalg.svd(x)[1])
    u = np.array([r["u"] for r in R.project(p, s, v).orderBy("id").collect()])
    assert np.allclose(u * s @ v.T, x) and np.allclose(u.T @ u, np.eye(4), atol=1e-8)
    table = R.scree(R.sigma_table(spark, s))
    assert R.rank_by_variance(table, 0.9).first()["k"] == 2 and R.rank_by_variance(table, 1.0).first()["k"] == 4
    with pytest.raises(ValueError):
        R.rank_by_variance(table, 0)
    df = spark.createDataFrame([(1.0, 5.0, "k"), (3.0, 5.0, "k")], "a double, b double, c string")
    got = R.standard_scaled(df, ["a", "b"]).collect()
    assert abs(got[0]["a"] + 2**-0.5) < 1e-12 and got[0]["b"] == 0.0 and got[0]["c"] == "k"
    assert tuple(R.elbows(R.scree(R.sigma_table(spark, [1.0]))).first()) == (None, None, None, 0)


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "b.csv").write_text(" 1 , 2\n\n3,4\n")
    (tmp_path / "m" / "a.csv").write_text("")
    (tmp_path / "m" / "c.csv").write_text("5,x\n6,7\n")
    (tmp_path / "m" / "note.txt").write_text("no")
    got = sorted((r["block_id"], r["v"]) for r in S.read_block_folder(spark, f"file://{tmp_path}/m").collect())
    assert got == [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [6.0, 7.0])]
    with pytest.raises(Exception, match="CAST|cast"):
        S.read_matrix(spark, f"file://{tmp_path}/m/c.csv").collect()
    (tmp_path / "l.txt").write_text("1\n\n 2 \n")
    assert [r[0] for r in S.read_labels(spark, f"file://{tmp_path}/l.txt").collect()] == [1, 2]
    (tmp_path / "r.csv").write_text("1,2,3,4,rose\n\n")
    assert S.read_records(spark, f"file://{tmp_path}/r.csv").first()["label"] == "rose"
    for n in ("chunk_2", "chunk_1", "other"):
        spark.range(1).write.parquet(f"file://{tmp_path}/w/{n}")
    assert len(S.read_chunks(spark, f"file://{tmp_path}/w")) == 2
    nested = spark.createDataFrame([(3, [[1.0], [2.0]]), (4, None)], "partition_id int, centers_list array<array<double>>")
    S.write_flat_centers(S.nested_centers(nested), f"file://{tmp_path}/flat")
    assert S.read_parquet(spark, f"file://{tmp_path}/flat").count() == 2
    S.write_parquet(spark.range(4), f"file://{tmp_path}/one", single_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_numbering_is_global(spark):
    from cairn.runtime import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = {r["k"]: r["n"] for r in numbered(df, ["k"], "n").collect()}
    assert got == {k: k for k in range(1000)} and numbered(df.limit(0), ["k"], "n").count() == 0
    assert numbered(spark.createDataFrame([(None,), ("b",), ("a",)], "k string"), ["k"], "n").orderBy("n").first()["k"] == "a"


def test_latest_rows(spark):
    from datetime import datetime

    from cairn.runtime import durable, latest

    day = [datetime(2012, 1, d) for d in (1, 2, 3)]
    rows = [("a", day[0], 1, [1.0]), ("a", day[2], 3, None), ("a", day[1], 2, [2.0]), ("b", None, 7, [7.0]), (None, day[0], 5, []), (None, day[1], 6, [6.0]), ("c", day[1], 4, [4.0]), ("c", day[1], 4, [4.0])]
    df = spark.createDataFrame(rows, "k string, at timestamp, n int, v array<double>")
    assert {r["k"]: (r["n"], r["v"]) for r in latest(df, ["k"], "at", ["n", "v"]).collect()} == {"a": (3, None), "b": (7, [7.0]), None: (6, [6.0]), "c": (4, [4.0])}
    assert latest(df.limit(0), ["k"], "at", ["n"]).count() == 0
    assert durable(df.limit(0)).schema == df.schema and durable(df).count() == 8
