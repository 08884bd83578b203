"""Vector expressions on every input shape, and their dirt."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cairn.functions import vectors as V

VEC = "id int, v struct<kind:tinyint,dim:int,idx:array<int>,vals:array<double>>"


def values(df):
    return [tuple(x) for x in (r["v"] for r in df.orderBy("id").collect())]


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "double"])
def test_number_arrays(spark, kind):
    cast = float if kind in ("float", "double") else int
    df = spark.createDataFrame([(1, [cast(1), cast(2)]), (2, None), (3, []), (4, [cast(3), None])], f"id int, x array<{kind}>")
    got = values(V.extract_points(df, "x", ["id"]))
    assert got[0] == (1.0, 2.0) and got[1][0] == 3.0 and math.isnan(got[1][1]) and len(got) == 2


def test_strings(spark):
    df = spark.createDataFrame([(1, [" 1.5", "x"]), (2, ["2", "3"])], "id int, x array<string>")
    got = values(V.extract_points(df, "x", ["id"]))
    assert got[0][0] == 1.5 and math.isnan(got[0][1]) and got[1] == (2.0, 3.0)
    assert values(V.extract_points(df.filter("id = 2"), "x", ["id"], strict=True)) == [(2.0, 3.0)]
    with pytest.raises(Exception, match="CAST|cast|malformed"):
        V.extract_points(df, "x", ["id"], strict=True).collect()


def test_ml_vectors_and_structs(spark):
    df = spark.createDataFrame([(1, Vectors.dense(1, 0, 2)), (2, Vectors.sparse(3, [1], [5.0]))], ["id", "x"])
    assert values(V.extract_points(df, "x", ["id"])) == [(1.0, 0.0, 2.0), (0.0, 5.0, 0.0)]
    assert [r[0] for r in df.select(V.vector_kind(df, "x")).collect()] == ["dense", "sparse"]
    s = spark.createDataFrame([(1, (3, [0, 2, 2, 9], [1.0, 2.0, 7.0, 4.0])), (2, (2, None, [3.0, 4.0]))], "id int, x struct<size:int,indices:array<int>,values:array<double>>")
    assert values(V.extract_points(s, "x", ["id"])) == [(1.0, 0.0, 7.0), (3.0, 4.0)]
    back = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>").select(V.to_ml_vector(F.col("v"))).first()[0]
    assert back == Vectors.dense(1, 2)
    with pytest.raises(TypeError):
        V.extract_points(spark.createDataFrame([(1, "a")], "id int, x string"), "x", ["id"])


def test_vec(spark):
    df = spark.createDataFrame([(1, (0, 4, [1, 3, 2], [5.0, 0.0, None])), (2, (1, None, None, [0.0, 2.0])), (3, None), (4, (0, 3, [], [])), (5, (0, 2, [1, 7, None], [1.0, 2.0, 3.0]))], VEC)
    got = {r[0]: r[1] and [tuple(e) for e in r[1]] for r in df.select("id", V.nonzero_entries(F.col("v"))).collect()}
    assert got == {1: [(1, 5.0)], 2: [(1, 2.0)], 3: None, 4: [], 5: [(1, 1.0), (7, 2.0)]}
    dense = {r[0]: r[1] for r in df.select("id", V.vec_to_array(F.col("v"))).collect()}
    assert dense == {1: [0.0, 5.0, 0.0, 0.0], 2: [0.0, 2.0], 3: None, 4: [0.0] * 3, 5: [0.0, 1.0]}


def test_strict_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id int, x array<double>")
    with pytest.raises(Exception, match="null vector"):
        V.extract_points(df, "x", ["id"], strict=True).collect()


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, 2.5, " 3 ")], "a int, b double, c string")
    assert df.select(V.row_vector(df, ["a", "b", "c"])).first()[0] == [1.0, 2.5, 3.0]
    with pytest.raises(TypeError):
        V.row_vector(spark.createDataFrame([(True,)], "a boolean"), ["a"])
    assert V.double_columns(df) == ["b"] and V.column_report(df)[0] == ("a", "scalar")
    got = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(*V.element_columns(F.col("v"), 3)).first()
    assert tuple(got) == (1.0, 2.0, None)


def test_profile_and_predicates(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0.0, 0.0), (None, None, 0.0), ([1.0], 1.0, 0.0)], "v array<double>, a double, b double")
    assert [r[0] for r in df.select(V.is_empty_vector(F.col("v"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(V.all_zero(["a", "b"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(V.vector_size(df, "v")).collect()] == [2, -1, 1] and df.select(V.vector_size(df, "a")).first()[0] == -2
    assert V.element_kind(df, "v") == "double"
