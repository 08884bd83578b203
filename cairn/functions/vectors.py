"""Expressions on vector columns.

A point is ``array<double>``.  Inputs of other shapes are brought to it by
expressions chosen from the column's data type, never by a Python function:
arrays of any number type or of numeric strings, ML vectors, and structs with
``values`` (sparse ones are densified).  VEC is the stored form
``struct<kind tinyint, dim int, idx array<int>, vals array<double>>``; kind 0 is
sparse (positions ``idx`` from 0, values ``vals``), kind 1 dense.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
EMPTY = "array<struct<term_index:int,value:double>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of one length; null if either is null or an element is."""
    return F.sqrt(squared_distance(a, b))


def nonzero_entries(vec: Column) -> Column:
    """array<struct<term_index int, value double>> of the non-zero positions of a VEC.

    Null for a null vector, empty for an empty one.  Stored zeros, nulls and
    positions without a value give no entry.
    """
    sparse = F.transform(F.arrays_zip(vec["idx"], vec["vals"]), lambda p: F.struct(p["idx"].cast("int").alias("term_index"), p["vals"].cast("double").alias("value")))
    dense = F.transform(vec["vals"], lambda x, i: F.struct(i.cast("int").alias("term_index"), x.cast("double").alias("value")))
    entries = F.when(vec["kind"] == 1, F.coalesce(dense, F.array().cast(EMPTY))).otherwise(F.coalesce(sparse, F.array().cast(EMPTY)))
    return F.when(vec.isNotNull(), F.filter(entries, lambda e: e["term_index"].isNotNull() & (F.coalesce(e["value"], F.lit(0.0)) != 0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scatter(size: pd.Series, idx: pd.Series, vals: pd.Series) -> pd.Series:
    out = []
    for n, i, v in zip(size, idx, vals):
        if n is None or n != n or i is None or v is None:
            out.append(None)
            continue
        n, m = max(int(n), 0), min(len(i), len(v))
        row = np.zeros(n)
        at, x = np.asarray(i[:m], float), np.asarray(v[:m], float)
        use = (at >= 0) & (at < n)
        row[at[use].astype(np.int64)] = np.nan_to_num(x[use], nan=0.0)
        out.append(row)
    return pd.Series(out, dtype=object)


def densify(size: Column, idx: Column, vals: Column) -> Column:
    """A dense array from positions and values.

    A position outside is dropped, the last of a repeated one counts, null and
    NaN values are zeros; null if an argument is.  No built-in scatters into an
    array in linear time, so this one runs in Arrow batches.
    """
    return _scatter(size.cast("int"), idx, vals)


def vec_to_array(vec: Column, size: Column | None = None) -> Column:
    """A VEC as a dense array of ``size`` (default: the vector's own ``dim``) elements."""
    return F.when(vec["kind"] == 1, vec["vals"]).when(vec["kind"] == 0, densify(size if size is not None else vec["dim"], vec["idx"], vec["vals"]))


def _as_array(column: Column, kind: T.DataType, number) -> Column:
    if isinstance(kind, VectorUDT):
        return vector_to_array(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: number(x, kind.elementType))
    if isinstance(kind, T.StructType):
        names = {f.name: f.dataType for f in kind.fields}
        if {"kind", "idx", "vals"} <= names.keys():
            return vec_to_array(column)
        if "values" in names:
            values = F.transform(column["values"], lambda x: number(x, names["values"].elementType))
            if {"size", "indices"} <= names.keys():
                return F.when(column["indices"].isNull() | column["size"].isNull(), values).otherwise(densify(column["size"], column["indices"], values))
            return values
    raise TypeError(f"no vector can be read from {kind.simpleString()}")


def _tolerant_number(x: Column, kind: T.DataType) -> Column:
    read = F.trim(x).try_cast("double") if isinstance(kind, T.StringType) else x.cast("double")
    return F.coalesce(read, F.lit(NAN))


def _strict_number(x: Column, kind: T.DataType) -> Column:
    read = F.trim(x).cast("double") if isinstance(kind, T.StringType) else x.cast("double")
    return F.when(x.isNull(), F.raise_error(F.lit("null element"))).otherwise(read)


def tolerant_vector(df: DataFrame, column: str) -> Column:
    """The column as array<double>: null elements and unreadable strings become NaN, empty vectors null."""
    v = _as_array(F.col(column), df.schema[column].dataType, _tolerant_number)
    return F.when(F.size(v) > 0, v)


def strict_vector(df: DataFrame, column: str) -> Column:
    """The column as array<double>; a null vector, a null element or an unreadable string raises."""
    v = _as_array(F.col(column), df.schema[column].dataType, _strict_number)
    return F.when(F.col(column).isNull(), F.raise_error(F.lit("null vector"))).otherwise(v)


def extract_points(df: DataFrame, column: str, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """``keep`` and ``v``; without ``strict`` rows whose vector is null, empty or unreadable are dropped."""
    if strict:
        return df.select(*keep, strict_vector(df, column).alias("v"))
    return df.select(*keep, tolerant_vector(df, column).alias("v")).filter("v is not null")


def row_vector(df: DataFrame, columns: Sequence[str]) -> Column:
    """All ``columns`` as one array; numbers are cast, strings trimmed and cast, anything else raises."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.NumericType, T.StringType)):
            raise TypeError(f"column {c} is no number: {kind.simpleString()}")
        parts.append(_strict_number(F.col(c), kind))
    return F.array(*parts)


def double_columns(df: DataFrame) -> list[str]:
    """The columns that are assembled when a table has no vector column."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]


def to_ml_vector(v: Column) -> Column:
    return array_to_vector(v)


def element_columns(v: Column, size: int, prefix: str = "feature_") -> list[Column]:
    """One column per element, in one projection."""
    return [F.get(v, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]


def vector_size(df: DataFrame, column: str) -> Column:
    """Elements of a vector; -1 for a null one, -2 for a column that is none."""
    try:
        v = _as_array(F.col(column), df.schema[column].dataType, _tolerant_number)
    except TypeError:
        return F.lit(-2)
    return F.when(F.col(column).isNull(), -1).otherwise(F.size(v))


def vector_kind(df: DataFrame, column: str) -> Column:
    """null, sparse, dense, array or unknown."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.ArrayType):
        named = F.lit("array")
    elif isinstance(kind, T.StructType) and "kind" in kind.names:
        named = F.when(c["kind"] == 0, "sparse").otherwise("dense")
    elif isinstance(kind, T.StructType) and "indices" in kind.names:
        named = F.when(c["indices"].isNull(), "dense").otherwise("sparse")
    elif isinstance(kind, VectorUDT):
        named = F.when(F.to_json(F.struct(c.alias("v"))).contains('"type":0'), "sparse").otherwise("dense")
    else:
        named = F.lit("unknown")
    return F.when(c.isNull(), "null").otherwise(named)


def element_kind(df: DataFrame, column: str) -> str:
    """The type of a vector's elements."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return kind.elementType.simpleString()
    return "double" if isinstance(kind, (VectorUDT, T.StructType)) else "unknown"


def column_report(df: DataFrame) -> list[tuple[str, str]]:
    """(column, vector, array, struct or scalar) of every column, from the schema alone."""
    name = lambda k: "vector" if isinstance(k, VectorUDT) else "array" if isinstance(k, T.ArrayType) else "struct" if isinstance(k, T.StructType) else "scalar"
    return [(f.name, name(f.dataType)) for f in df.schema.fields]


def is_empty_vector(v: Column) -> Column:
    """Null, or without a non-zero element."""
    return F.coalesce(~F.exists(v, lambda x: F.coalesce(x, F.lit(0.0)) != 0), F.lit(True))


def all_zero(columns: Sequence[str]) -> Column:
    """Are all of these columns strictly zero?  A null is not."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) == 0.0, F.lit(False))
    return out
